from __future__ import annotations

import random

import pandas as pd
import pytest

from tradeloom.operators import common as C
from tradeloom.operators import review as V
from tradeloom.streaming import events as S


@pytest.mark.parametrize("few", [0, 64])
@pytest.mark.parametrize("size", [None, 3])
def test_texts_that_contain_others(spark, monkeypatch, few, size):
    """All pairs, by grams and by comparing, also for parts shorter than a gram and for repeated rows."""
    monkeypatch.setattr(C, "FEW", few)
    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("abcé 1", k=rng.randrange(n)))
    parts, wholes = [(i, text(8)) for i in range(60)] + [(60, None), (61, "a"), (61, "a")], [(i, text(25)) for i in range(80)] + [(80, None), (81, "")]
    got = C.contained_in(spark.createDataFrame(parts, "p int, part string"), spark.createDataFrame(wholes, "w int, whole string"), "part", "whole", size).select("p", "w").collect()
    expected = [(p, w) for p, part in parts for w, whole in wholes if part and whole is not None and len(part) >= (size or 1) and part in whole]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_rules_are_found_as_one_by_one(spark):
    rules = spark.createDataFrame([("r1", "7318", "BOLTS", ["bolt", "Nut x"]), ("r2", "8205", None, None), ("r3", None, "Seven 7", ["anvil"])], "id string, code string, category string, patterns array<string>")
    asked = [("nut", "all"), ("7", "all"), ("7", "code"), ("7", "category"), ("ANVIL", "patterns"), ("bolt", "code"), ("", "all"), ("zz", "all")]
    got = sorted((r.word, r.field, r.id) for r in V.rules_queried(rules, spark.createDataFrame(asked, "word string, field string")).collect())
    expected = sorted((w, f, r.id) for w, f in asked if w for r in V.rules_found(rules, w, f).collect())
    assert got == expected and len(got) > 5


class State:
    """What the state of one client does."""

    def __init__(self):
        self.value, self.hasTimedOut, self.until = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, at):
        self.until = at

    def getCurrentWatermarkMs(self):
        return 0


def test_a_client_is_forgotten(monkeypatch):
    """Three tries, then none, until nothing was heard of the client for thirty days."""
    held = {}

    class Events:
        def withWatermark(self, *args):
            return self

        groupBy = withWatermark

        def applyInPandasWithState(self, step, *args):
            held["step"] = step

    S.retried(Events(), "client", "id", "at")
    state, day = State(), pd.Timestamp("2026-01-01")
    run = lambda ids: [f.values.tolist() for f in held["step"]((5,), iter([pd.DataFrame({"id": ids, "at": [day] * len(ids)})]), state)][0]
    assert run([4, 2]) == [[5, 2, 1], [5, 4, 2]] and run([9, 7]) == [[5, 7, 3]] and run([11]) == []
    assert state.until == day.value // 1_000_000 + 30 * 86_400_000
    state.hasTimedOut = True
    assert run([]) == [] and not state.exists
    state.hasTimedOut = False
    assert run([12]) == [[5, 12, 1]]

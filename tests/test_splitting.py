from __future__ import annotations

import random
import time
from itertools import product

import numpy as np
import pytest

from tradeloom.operators import ordering as O
from tradeloom.operators import splitting as S
from tradeloom.operators import subsets


def best_of_all(costs, targets):
    """The first way of two sides with the least score, over all masks; sums are whole cents."""
    cents = [round(c * 100) for c in costs]
    sums = subsets._all_sums(cents)
    worst, gaps = subsets._scores(sums, sum(cents), targets)
    worst = np.where((np.arange(len(sums)) > 0) & (np.arange(len(sums)) < len(sums) - 1), worst, np.inf)
    mask = int(np.lexsort((np.arange(len(sums)), gaps, worst))[0])
    return [1 - (mask >> i & 1) for i in range(len(costs))]


def amounts(rng, n):
    return [round(rng.choice([0, 1, 5, rng.random() * 100, rng.random() * 100]), 2) for _ in range(n)]


def test_two_sides_are_the_best_ones():
    rng = random.Random(4)
    for n in [*range(2, 15)] * 12 + [16, 18, 20]:
        costs = amounts(rng, n)
        targets = [rng.random() * sum(costs) + 0.1, rng.random() * sum(costs) + 0.1]
        assert subsets.two_sides(costs, targets) == best_of_all(costs, targets)


def test_sides_by_bits(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(subsets, "MIDDLE", 1)
    for n in [*range(2, 15)] * 12:
        costs = amounts(rng, n)
        targets = [rng.random() * sum(costs) + 0.1, rng.random() * sum(costs) + 0.1]
        assert subsets.two_sides(costs, targets) == best_of_all(costs, targets)
    monkeypatch.setattr(subsets, "MOST_BITS", 10)
    assert subsets.two_sides([1.0, 2.0], [1.0, 2.0]) is None and subsets.two_sides([1.0], [1.0, 2.0]) is None


def test_halves_of_many_items():
    """Sixteen items and more: no worse than the best, where dealing the largest first is."""
    rng, better = random.Random(6), 0
    for n in (16, 17, 18, 40, 90):
        costs = [round(rng.random() * 100, 2) for _ in range(n)]
        half = [sum(costs) / 2] * 2
        exact, greedy = (O.deviation(O._sums(costs, way, 2), half) for way in (O.divided(costs, half), O._one_by_one(costs, half)))
        assert exact <= greedy and abs(exact[0]) < 0.001
        better += exact < greedy
    assert better >= 4


def test_several_sides_are_the_best_ones(monkeypatch):
    rng = random.Random(7)
    for _ in range(40):
        n = rng.choice([2, 3, 4])
        costs = [float(rng.randrange(0, 60)) for _ in range(rng.randrange(n, 8))]
        targets = [float(rng.randrange(1, 60)) for _ in range(n)]
        monkeypatch.setattr(O, "AT_ONCE", rng.choice([8, 64, 1 << 16]))
        ways = [w[::-1] for w in product(range(n), repeat=len(costs)) if len(set(w)) == n]  # the first item's changes fastest
        best = min(ways, key=lambda w: O.deviation(O._sums(costs, w, n), targets))
        assert O._all_ways(costs, targets)[1] == list(best)


def test_fifteen_items_of_four_declarations_in_time():
    costs, began = [round(random.Random(8).random() * 100, 2) for _ in range(15)], time.perf_counter()
    O._all_ways(costs, [sum(costs) / 4] * 4)
    assert time.perf_counter() - began < 30


@pytest.mark.parametrize(
    ("costs", "targets", "charges", "expected"),
    [
        ([10.0, 20.0, 30.0], [30.0, 30.0], [], ("duty", [0, 0, 1])),
        ([10.0, 20.0, 30.0], [0.5, 30.0], [], None),  # a target near nothing isn't trusted
        ([10.0, 20.0, 30.0], [0.5, 30.0], [32.1, 32.1], ("charges", [0, 0, 1])),
        ([10.0, 20.0, 30.0], [None, None], [10.7, 53.5], ("charges", [0, 1, 1])),
        ([10.0, 20.0, 30.0], [None, 50.0], [], None),
        ([10.0, 20.0, 30.0], [None, 5000.0], [0.8, 0.9], None),
        ([10.0], [5.0, 5.0], [5.0, 5.0], None),
    ],
)
def test_strategies(costs, targets, charges, expected):
    assert S.strategy(costs, targets, charges, 0.07) == expected


def test_unknown_targets_are_filled_in_from_charges():
    """The charges' own division is unreliable (one is near nothing), the known target and the other charge are not."""
    assert S.strategy([10.0, 20.0, 30.0], [None, 30.0], [0.5, 33.0], 0.0) is None
    assert S.strategy([32.0, 1.0], [1.2, None], [33.0, 0.9], 0.0) == ("mixed", [1, 0])
    assert S.strategy([32.0, 1.0], [None, 1.2], [33.0, 0.9], 0.0) == ("mixed", [0, 1])


def test_units_and_turns():
    row = lambda seq, name, quantity, unit, total: (1, seq, name, "c", quantity, unit, total, [None, None, None], [], 0.07)
    units = S.split([row(1, "a", 3.0, 1.005, 3.02), row(2, "b", 2.0, None, 5.0)], 3)
    assert units == [(1, 0, 1, 1.0, 1.005, 1.01, "quantity"), (1, 1, 1, 1.0, 1.005, 1.01, "quantity"), (1, 2, 1, 1.0, 1.005, 1.01, "quantity"), (1, 0, 2, 1.0, 2.5, 2.5, "quantity"), (1, 1, 2, 1.0, 2.5, 2.5, "quantity")]
    assert [r[1] for r in S.split([row(i, "a", 1.0, 1.0, 1.0) for i in range(5)], 3)] == [0, 1, 2, 0, 1]
    assert S.split([row(1, "a", 1.0, 2.0, 2.0)], 3)[0][-1] == "turn"


def test_items_of_null_amounts(spark):
    items = spark.createDataFrame([(1, 1, None, None, None, None, None), (1, 2, "b", "c", 2.0, 3.0, 6.0), (2, 1, "x", "y", 1.0, 1.0, 1.0)], "invoice_id long, seq int, description string, tariff_code string, quantity double, unit_cost double, total_cost double")
    declarations = spark.createDataFrame([(1, 0, None), (1, 1, None), (2, 0, 5.0)], "invoice_id long, declaration int, target double")
    invoices = spark.createDataFrame([(3, 1.0, 2.0, [1.0])], "invoice_id long, tax double, invoice_total double, charges array<double>")
    got = sorted(map(tuple, S.items_split(items, declarations, invoices).select("invoice_id", "declaration", "seq", "total_cost", "strategy").collect()))
    assert got == [(1, 0, 1, 0.0, "turn"), (1, 1, 2, 6.0, "turn")]
    assert S.items_split(items.limit(0), declarations, invoices).count() == 0


def test_divisions_together_are_those_one_by_one(monkeypatch):
    rng = random.Random(3)
    asked = []
    for _ in range(300):
        n = rng.choice([1, 2, 2, 3, 3, 4])
        costs = [rng.choice([0.0, 5.0, 5.0, round(rng.uniform(1, 900), 2)]) for _ in range(rng.randint(1, 7))]
        asked.append((costs, [rng.choice([0.0, 10.0, sum(costs) / n, rng.uniform(0, 500)]) for _ in range(n)]))
    plain, alone = O.divided, []
    expected = [plain(*a) for a in asked]
    monkeypatch.setattr(O, "SUMS_AT_ONCE", 2000)
    monkeypatch.setattr(O, "divided", lambda costs, targets, exhaustive=15: alone.append(targets) or plain(costs, targets, exhaustive))
    assert O.divided_together(asked) == expected
    # only what has one declaration or too few items is divided by itself
    assert len(alone) == sum(len(t) < 2 or len(c) < len(t) for c, t in asked)

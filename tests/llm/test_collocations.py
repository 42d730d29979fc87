from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import documents
from tradeloom.llm import collocations
from tradeloom.llm.perfect_hash import PerfectHash


def by_force(docs, least, top, factor=1000):
    """The definitions, phrase by phrase."""
    n, f = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    often = {p: a for p, a in f.items() if a >= least}
    rows = []
    for (lang, words), a in often.items():
        if len(words) < 2:
            continue
        if any(la == lang and len(w) > len(words) and 100 * b >= 100 * a and any(w[i : i + len(words)] == words for i in range(len(w))) for (la, w), b in often.items()):
            continue
        score, _, left, right = min((factor * a * n[lang] // (f[lang, words[:c]] * f[lang, words[c:]]), c, f[lang, words[:c]], f[lang, words[c:]]) for c in range(1, len(words)))
        rows.append((lang, -score, -a, " ".join(words).encode(), left, right))
    out, at = [], Counter()
    for lang, score, a, phrase, left, right in sorted(rows):
        at[lang] += 1
        if at[lang] <= top:
            out.append((lang, at[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(docs, **parameters):
    return sorted(map(tuple, collocations.collocations(docs, **parameters).collect()))


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    expected = con.sql(collocations.OP12_SQL).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").fetchall()
    assert found(spark.read.parquet(f"{sf}/documents.parquet")) == sorted(expected)


@pytest.fixture(scope="module")
def texts():
    rng, out = random.Random(11), []
    for _ in range(120):
        words = rng.choices(["a", "B", "c", "the", "éa", "x-y", "New York", "New York City hall", "q" * 300, "é"], [9, 8, 7, 9, 3, 2, 4, 3, 1, 2], k=rng.randrange(0, 60))
        out.append(("".join(w + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\x0b", " ,"]) for w in words), rng.choice(["en", "en", "de", None, ""])))
    return out + [(None, "en"), ("", None), ("...", "fr"), out[0], out[0]]


@pytest.mark.parametrize(("block_size", "top"), [(1 << 20, 2000), (40, 7)])
def test_against_force(spark, texts, block_size, top):
    docs = documents(spark, [(i, t, lang) for i, (t, lang) in enumerate(texts)]).repartition(4)
    assert found(docs, least=6, top=top, block_size=block_size) == by_force(texts, 6, top)


def test_small_tables_of_the_tasks(spark, texts, monkeypatch):
    """Words forgotten, rows and buckets handed on all the time."""
    for name, value in (("REMEMBERED", 3), ("ROW_WORDS", 5), ("HELD", 4)):
        monkeypatch.setattr(collocations, name, value)
    rows = iter(collocations.Buckets(20, 3).add(np.arange(9, dtype=np.uint64)))
    assert next(rows).num_rows
    docs = documents(spark, [(i, t, lang) for i, (t, lang) in enumerate(texts)])
    assert found(docs, least=6) == by_force(texts, 6, 2000)


def test_a_collision_of_numbers_is_seen(spark, texts, monkeypatch):
    """With the first seed all words of three letters have one number."""
    plain, seeds = collocations._mined, []

    def mined(docs, seed, *rest):
        seeds.append(seed)
        if seed == 0:
            raise collocations.Collision
        return plain(docs, seed, *rest)

    monkeypatch.setattr(collocations, "_mined", mined)
    docs = documents(spark, [(i, t, lang) for i, (t, lang) in enumerate(texts)])
    assert found(docs, least=6) == by_force(texts, 6, 2000) and seeds == [0, 1]


def test_nothing_and_unmet_bound(spark, nothing, odd):
    assert found(nothing) == [] and found(odd, least=10**6) == []


def test_exact_scores(spark):
    """Products beyond 64 bits."""
    rows = spark.createDataFrame([("en", 2, [1, 2], 3 * 10**12, [4 * 10**15, 7 * 10**14])], collocations.PHRASES)
    totals = spark.createDataFrame([("en", 9 * 10**18)], "lang string, n long")
    assert collocations.scored(rows, totals, 1000).first().score == 1000 * 3 * 10**12 * 9 * 10**18 // (4 * 10**15 * 7 * 10**14)


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 50_000, dtype=np.uint64)
    keys = np.unique(keys)
    made = PerfectHash(keys)
    assert sorted(made.slots(keys).tolist()) == list(range(len(keys))) and made.size == len(keys)
    assert sum(w.nbytes + r.nbytes for _, w, r in made.tables) * 8 < 10 * len(keys)
    assert (PerfectHash(keys[:0]).slots(keys[:3]) == -1).all()


def test_buckets_are_small():
    """Numbers of a task are handed on in less than two bytes a bucket, and read back."""
    at = np.unique(np.random.default_rng(2).integers(0, 1 << 24, 1_100_000)).astype(np.uint64)
    sums = collocations.Buckets(24, 100)
    rows = [r for b in (*sums.add(at << np.uint64(40)), *sums.handed_on()) for r in b.to_pylist()]
    assert sum(len(r["at"]) + len(r["n"]) for r in rows) < 1.5 * len(at)
    assert np.concatenate([collocations._places(r["at"]) + (r["chunk"] << collocations.CHUNK_BITS) for r in rows]).tolist() == at.tolist()
    for kind in (np.uint8, np.uint32, np.int64):
        for n in (np.array([], dtype=kind), np.array([0, 3, 100, 7], dtype=kind)):
            assert collocations._spread(collocations._squeezed(n), kind).tolist() == n.tolist()


def test_known_phrases_are_not_listed_again():
    """All that are stored, and only those: a phrase of a stored one's hash with other words is listed."""
    v = np.array([5, 6, 5, 6, 0], dtype=np.uint64)
    row = pa.RecordBatch.from_arrays([pa.array(["en"]), *(pa.array([x], pa.binary()) for x in collocations._packed(v))], names=["lang", "values", "codes"])
    listed = lambda known: [(k, w0, w1) for b in collocations._distinct([row], [], np.uint64(44), known) for k, w0, w1 in zip(*(b.column(c).to_pylist() for c in ("k", "w0", "w1")), strict=True)]
    g = collocations.hashes(np.array([[5, 6]], dtype=np.uint64))
    block = lambda w0: collocations.Block(["en"], np.zeros(1, int), np.array([2]), g, np.array([[w0, 6, 0, 0, 0]], dtype=np.uint64))
    assert (2, 5, 6) in listed(None) and (2, 5, 6) in listed(block(9)) and (2, 5, 6) not in listed(block(5))
    assert {(1, 5, 0), (1, 6, 0), (2, 6, 5)} <= set(listed(block(5)))


def test_one_python_worker_a_task(spark, texts, monkeypatch):
    """No stage runs Python functions one after another: each would have a worker that keeps its memory."""
    plans, plain = [], collocations.written
    monkeypatch.setattr(collocations, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, name))
    docs = documents(spark, [(i, t, lang) for i, (t, lang) in enumerate(texts)]).repartition(9)
    assert found(docs, least=6) == by_force(texts, 6, 2000)
    apart = [part for plan in plans for part in re.split(r"Exchange|Union", plan)]
    assert len(plans) > 6 and max(part.count("MapInArrow") for part in apart) == 1

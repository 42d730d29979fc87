from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import documents
from tradeloom.llm import filter_audit, weighted_samples


def similarity(one: Counter, other: Counter) -> float:
    return sum((one & other).values()) / max(1, sum((one | other).values()))


def expected_edits(rows):
    """By row: the edited text and the next document's text, by brute force."""
    key = lambda d: -(1 << 63) if d is None else d
    least = {}
    for d, t in rows:
        least[key(d)] = min(least.get(key(d), t or ""), t or "", key=str.encode)
    ids = sorted(least)
    after = dict(zip(ids, [*ids[1:], *ids[:1]], strict=True))
    out = []
    for d, t in rows:
        text, following = t or "", least[after[key(d)]]
        cut = len(text) // 4
        out.append((d, text[: len(text) - cut] + following[:cut], following))
    return out


def test_collisions_are_as_frequent_as_similarity():
    """The mean over many pairs of the difference between equal samples and similarity is near zero, and its spread that of a share of 128 draws."""
    sampler, rng, off = weighted_samples.Sampler(), random.Random(3), []
    for _ in range(600):
        vocabulary = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 120))]
        one, other = (rng.choices(vocabulary, k=rng.randrange(5, 200)) for _ in range(2))
        same = float(np.mean(sampler.fingerprint(" ".join(one)) == sampler.fingerprint(" ".join(other))))
        truth = similarity(Counter(one), Counter(other))
        off.append((same - truth) / max((truth * (1 - truth) / 128) ** 0.5, 1e-3))
    assert abs(np.mean(off)) < 0.15 and 0.85 < np.std(off) < 1.15


def test_draws_are_remembered_unchanged(monkeypatch):
    texts = [" ".join(f"t{(i * j) % 301}" for j in range(200)) for i in range(1, 40)]
    plain = [weighted_samples.written_out(weighted_samples.Sampler().fingerprint(t)) for t in texts]
    monkeypatch.setattr(weighted_samples, "REMEMBERED", 256)
    small = weighted_samples.Sampler()
    assert [weighted_samples.written_out(small.fingerprint(t)) for t in texts + texts] == plain + plain


@pytest.mark.parametrize("range_rows", [20_000, 40])
def test_edits_of_all_documents(spark, sf, range_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3, "text")
    got = {r.doc_id: r for r in weighted_samples.edited(docs, range_rows=range_rows).collect()}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    own, near = weighted_samples.Sampler(), []
    for (d, text, following), (_, raw) in zip(expected_edits(rows), rows, strict=True):
        r = got.pop(d)
        prints = [own.fingerprint(t) for t in (raw or "", text, following)]
        assert r.n_chars == len(raw or "") and r.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == tuple(map(weighted_samples.written_out, prints[:2]))
        assert (r.near_edited, r.near_next) == (np.mean(prints[0] == prints[1]), np.mean(prints[0] == prints[2]))
        near.append((r.near_edited, similarity(Counter((raw or "").encode().split()), Counter(text.encode().split()))))
    assert not got
    assert abs(np.mean([a - b for a, b in near])) < 0.02


def test_edits_of_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    expected = sorted((d is not None, d or 0, len(t or ""), hashlib.sha256(e.encode()).hexdigest()) for (d, e, _), (_, t) in zip(expected_edits(rows), rows, strict=True))
    got = weighted_samples.edited(odd).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got) == expected
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {"0" * 512}
    assert weighted_samples.edited(nothing).count() == 0 and weighted_samples.fingerprints(nothing).count() == 0
    one = weighted_samples.edited(documents(spark, [(7, "a b c d", "en")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b c a").hexdigest()


def test_one_id_is_split(spark):
    """A third of all rows under one id: they are read by several tasks and have the same next document."""
    docs = documents(spark, [(50 if i % 3 == 0 else i, f"text {i} of {i % 7} words", "en") for i in range(600)])
    placed = weighted_samples.with_next(docs, range_rows=50).withColumn("part", F.spark_partition_id()).filter("not lead")
    assert max(r["count"] for r in placed.groupBy("part").count().collect()) <= 120
    assert placed.filter("key = 50").select("part").distinct().count() >= 3
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.edited_sha256) for r in weighted_samples.edited(docs, range_rows=50).collect())
    assert got == sorted((d, hashlib.sha256(e.encode()).hexdigest()) for d, e, _ in expected_edits(rows))


def test_likeness_of_columns(spark, sf):
    rows = weighted_samples.fingerprints(spark.read.parquet(f"{sf}/documents.parquet").limit(20), samples=32)
    pairs = rows.crossJoin(rows.toDF("other_id", "other")).select("fingerprint", "other", weighted_samples.likeness(F.col("fingerprint"), F.col("other")).alias("like")).collect()
    for r in pairs:
        assert r.like == sum(r.fingerprint[i : i + 4] == r.other[i : i + 4] for i in range(0, 128, 4)) / 32


def audit_by_force(docs, labels):
    """All counts from the definitions, document by document."""
    fails = []
    for d, text, source in docs:
        text = text or ""
        words = text.encode().split()
        f = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": any(o is not None and d is not None and o < d and (t or "") == text for o, t, _ in docs),
        }
        fails.append((source or "", {k for k, v in f.items() if v}, *labels.get(d, (0, 0))))
    out = {}
    for part in {f[0] for f in fails}:
        mine = [f[1:] for f in fails if f[0] == part]
        removed_by = Counter()
        for order in permutations("ABCDE"):
            for i, own in enumerate(order):
                gone = [f for f in mine if f[0] & set(order[:i])]
                here = [f for f in mine if own in f[0] and not f[0] & set(order[:i])]
                removed_by[own] += len(here)
                out[part, "".join(order), i + 1] = [
                    len(mine) - len(gone) - len(here), len(here), sum(own in f[0] for f in gone), sum(f[0] == {own} for f in mine),
                    sum(f[1] == 1 for f in here), sum(f[2] == 1 for f in here),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


def as_rows(frame):
    return {(r.part, r.filter_order, r.step): list(r)[3:] for r in frame.collect()}


def test_audit_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    frame = filter_audit.op13_filter_audit(spark, sf)
    expected = con.sql(filter_audit.OP13_SQL)
    assert sorted(map(tuple, frame.collect())) == sorted(expected.select(*frame.columns).fetchall())


@pytest.mark.parametrize("held", [64 << 20, 300])
def test_audit_of_odd_rows(spark, nothing, monkeypatch, held):
    monkeypatch.setattr(filter_audit, "HELD_BYTES", held)
    rng, rows = random.Random(5), []
    for i in range(150):
        text = rng.choice([None, "", " ", "a b", "A B C D", "x#", "a " * 60, " ".join(f"w{j}" for j in range(70)), " ".join(f"W{j}" for j in range(70)), f"own {i}", "y" * 3000])
        rows.append((rng.choice([None, i, i, i, 40]), text, "en", rng.choice([None, "", "s", "t"])))
    rows += [rows[3], rows[3], (40, "a b", "en", "s"), (40, "a b", "en", "t")]
    docs = spark.createDataFrame([(d, t, lang, s, 1, "x", 2) for d, t, lang, s in rows], "doc_id long, text string, lang string, source string, n int, part string, mask int").repartition(5)
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(0, 150, 2)] + [(40, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    known = {r.doc_id: (r.quality, r.toxic) for r in labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).collect() if r.doc_id is not None}
    assert as_rows(filter_audit.audited(docs, labels)) == audit_by_force([(d, t, s) for d, t, _, s in rows], known)
    assert filter_audit.audited(nothing, labels).count() == 0


def test_chains_hold_texts_of_one_hash(monkeypatch):
    """All texts under one hash: they are told apart by their bytes."""
    monkeypatch.setattr(filter_audit.xxhash, "xxh64_intdigest", lambda raw: 7)
    rows = [(i, f"text {i % 4}", "s") for i in range(40, 0, -1)]
    known = list(filter_audit.chained(sorted(filter_audit.met(rows), key=lambda r: r[0])))
    assert sorted(d for d, _, mask, _ in known if not mask & filter_audit.COPY) == [1, 2, 3, 4]
    assert sum(n for *_, n in known) == 40


def test_copies_leave_a_task_as_one_text():
    out = list(filter_audit.met([(i, "copy " * 9, "s") for i in range(5000)]))
    assert sum(v[0] is not None for _, v in out) == 1 and sum(v[4] for _, v in out if v[0] is None) == 4999

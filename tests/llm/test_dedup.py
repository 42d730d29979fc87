from __future__ import annotations

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import documents
from tradeloom.llm import components, exact_dedup, sharding, simhash, substring_dedup
from tradeloom.llm.rolling import content_hashes, running_least, windows, word_hashes


def same_as_sql(spark, sf, query, sql):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    expected = con.sql(sql)
    columns = sorted(expected.columns)
    got = query(spark, sf).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(expected.select(*columns).fetchall())


def test_exact_sql(spark, sf):
    same_as_sql(spark, sf, exact_dedup.op8_exact_dedup, exact_dedup.OP8_SQL)


def test_substring_sql(spark, sf):
    same_as_sql(spark, sf, substring_dedup.op4_substring_dedup, substring_dedup.OP4_SQL)


def test_many_levels(spark, sf, monkeypatch):
    """Runs taken in one by one, and filters so small that they let nearly everything through."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7, "doc_id")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    expected = sorted(map(tuple, exact_dedup.exact_dedup(docs).select(columns).collect()))
    monkeypatch.setattr(exact_dedup, "BATCHES", 7)
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs).select(columns).collect())) == expected
    monkeypatch.setattr(exact_dedup, "LEAST_BITS", 64)
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", 64)
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs).select(columns).collect())) == expected
    kept = {r.doc_id for r in exact_dedup.kept_documents(docs).select("doc_id").collect()}
    assert kept == {r[0] for r in expected if r[3]}


def test_filters(spark):
    """A filter has all of its keys and few others."""
    keys = spark.range(5000).withColumnRenamed("id", "digest")
    found = exact_dedup.probed(spark.range(20000).withColumnRenamed("id", "digest"), "digest", exact_dedup.bitmap(keys, "digest", 1 << 18), 1 << 18)
    hit = {r.digest for r in found.filter("maybe").collect()}
    assert hit >= set(range(5000)) and len(hit) < 5600


def test_weak_digests_are_split_by_bytes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    weak = exact_dedup.exact_dedup(docs, digest=lambda n: F.substring(F.md5(n.cast("binary")), 1, 1))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, weak.select(columns).collect())) == sorted(map(tuple, exact_dedup.op8_exact_dedup(spark, sf).select(columns).collect()))


def test_heavy_groups(spark):
    docs = documents(spark, [(i, "copy" if i % 3 else f"own {i}", "en") for i in range(3600)])
    rows = exact_dedup.exact_dedup(docs).collect()
    assert sum(r.kept for r in rows) == 1201 and {r.group_size for r in rows} == {1, 2400}
    assert {r.keep_id for r in rows if r.group_size > 1} == {1}


def test_exact_odd_rows(spark, odd, nothing):
    rows = exact_dedup.exact_dedup(odd).collect()
    by = {}
    for r in rows:
        by.setdefault(r.text_sha256, []).append(r)
    blank = by[hashlib.sha256(b"").hexdigest()]
    assert {r.doc_id for r in blank} == {1, 2, 3} and [r.doc_id for r in blank if r.kept] == [3]  # the longest text stays
    same = by[hashlib.sha256(b"thesametext").hexdigest()]
    assert len(same) == 4 and {r.keep_id for r in same} == {4} and sum(r.kept for r in same) == 1
    assert all(sum(r.kept for r in g) == 1 for g in by.values()) and len(rows) == odd.count()
    kept = exact_dedup.kept_documents(odd)
    assert kept.columns == odd.columns and kept.count() == len(by)
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_lookup(spark, odd):
    """A further batch is looked up, and taken in as a level that isn't merged yet."""
    index = exact_dedup.compact(exact_dedup.flush(odd, "doc_id", "text", exact_dedup.sha256_digest))
    new = spark.createDataFrame([(90, "the  same text"), (91, "unseen")], "doc_id long, text string")
    assert [(r.doc_id, r.keep_id) for r in exact_dedup.lookup(index, new).collect()] == [(90, 4)]
    batch = exact_dedup.flush(new, "doc_id", "text", exact_dedup.sha256_digest)
    index.levels = exact_dedup.taken_in(index.levels, batch)
    assert len(index.levels) == 2
    assert [(r.doc_id, r.keep_id) for r in exact_dedup.lookup(index, new.withColumn("keep", F.lit(1))).orderBy("doc_id").collect()] == [(90, 90), (91, 91)]  # the longest stays
    sizes = {r.doc_id: r.group_size for r in index.entries.select("head.doc_id", "group_size").collect()}
    assert sizes[90] == 5 and sizes[91] == 1


def brute_fingerprint(text, size):
    w = text.encode().lower().split()
    parts = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints, radius):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= radius and top(i) != top(j):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in ids}


def test_simhash_query(spark, sf, monkeypatch):
    prints = {r.doc_id: brute_fingerprint(r.text, 4) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    expected = {(i, f"{prints[i]:016x}", c) for i, c in brute_classes(prints, 4).items()}
    assert set(map(tuple, simhash.op2_simhash(spark, sf).collect())) == expected
    for splits in (3, 1):  # nearly all shards are split, and then searched in parts
        monkeypatch.setattr(simhash, "SHARD", 2)
        monkeypatch.setattr(simhash, "SPLITS", splits)
        assert set(map(tuple, simhash.op2_simhash(spark, sf).collect())) == expected


def test_simhash_close_prints(spark):
    """Clusters of fingerprints within a few bits, linked over chains."""
    r = random.Random(5)
    prints = {}
    for _ in range(30):
        v = r.getrandbits(64)
        for _ in range(12):
            prints[len(prints)] = v
            for b in r.sample(range(64), r.randint(0, 7)):
                v ^= 1 << b
    frame = spark.createDataFrame([(i, [simhash._as_long(v)]) for i, v in prints.items()], "node long, lanes array<long>")
    joined = {x.node: x.component for x in components.components(simhash.links(frame, simhash.Near())).collect()}
    assert {i: joined.get(i, i) for i in prints} == brute_classes(prints, 4)


def test_simhash_odd_rows(spark, odd, nothing):
    rows = simhash.classes(odd, simhash.Near()).collect()
    assert len(rows) == odd.count()
    zero = [r for r in rows if r.lanes == [0]]
    assert {r.doc_id for r in zero} == {1, 2, 3} and {r.component_id for r in zero} == {1}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert simhash.classes(nothing, simhash.Near()).count() == 0


def test_bk_tree():
    r = random.Random(2)
    values = [r.getrandbits(16) for _ in range(300)]
    tree = simhash.BkTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.within(q, 3)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 3]


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, 2000 + i) for i in range(1, 300)]
    root = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: c for n, c in root.items() if n in got} and all(n == root[n] for n in root if n not in got)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_removed(docs, size):
    first = {}
    words = {i: t.encode().split() for i, t in docs}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k : k + size]), (i, k))
    out = {}
    for i, w in words.items():
        gone = {x for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] != (i, k) for x in range(k, k + size)}
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def test_substring_query(spark, sf):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = {(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, (n, g, k) in brute_removed(docs, 20).items()}
    assert set(map(tuple, substring_dedup.op4_substring_dedup(spark, sf).collect())) == expected


def test_substring_repeats(spark, monkeypatch):
    """Few words, so that windows repeat within and across documents; small flushes."""
    monkeypatch.setattr(substring_dedup, "HELD", 50)
    r = random.Random(8)
    for size in (3, 5, 12):
        docs = [(i, " ".join(r.choice("ab c".split()) if i % 2 else "ab" for _ in range(r.randrange(60)))) for i in range(60)]
        got = {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in substring_dedup.substring_dedup(documents(spark, [(i, t, "en") for i, t in docs]), size).collect()}
        assert got == brute_removed(docs, size)


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_substring_of_words_that_polynomials_confuse(spark):
    """Long words whose polynomials are equal modulo 2^64 for every base, and windows of two words in that order."""
    same = [f"same{i}" for i in range(19)]
    docs = []
    for k, n in enumerate((1024, 4096)):
        docs += [(10 * k + 1, " ".join([*(f"own{k}x{i}" for i in range(25)), thue_morse(n, "a", "b"), *same])), (10 * k + 2, " ".join([thue_morse(n, "b", "a"), *same]))]
    docs += [(50, " ".join(thue_morse(64, "x", "y"))), (51, " ".join(thue_morse(64, "y", "x"))), (52, " ".join(thue_morse(32, "x", "y")))]
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in substring_dedup.substring_dedup(documents(spark, [(i, t, "en") for i, t in docs])).collect()}
    assert got == brute_removed(docs, 20) and got[2][1] == 0 and got[12][1] == 0


def test_one_row_many_times(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = substring_dedup.substring_dedup(documents(spark, [(5, text, "en")] * 400 + [(9, text, "en")])).collect()
    assert len(rows) == 401 and {(r.doc_id, r.n_removed) for r in rows} == {(5, 0), (9, 30)}


def test_substring_odd_rows(spark, odd, nothing):
    rows = substring_dedup.substring_dedup(odd, 2).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_words == 0 and by[1][0].kept == ""
    assert by[4][0].n_removed == 0 and [r.n_removed for r in by[5]] == [3, 3]
    assert by[6][0].n_removed == 0 or by[6][0].removed[0].start > 0
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_rolling():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    w = np.concatenate([v, v])
    h = windows(w, 20, 0x9E3779B97F4A7C15)
    assert (h[:481] == h[500:]).all() and len(np.unique(h[:500])) == 500
    assert running_least(v, 13).tolist() == [v[i : i + 13].min() for i in range(488)]
    a, b = word_hashes(b" one two\tthree one ".split())
    assert len(a) == 4 and a[0] == a[3] and len(set(a.tolist())) == len(set(b.tolist())) == 3 and not set(a.tolist()) & set(b.tolist())
    assert len(word_hashes([])[0]) == 0
    words = "a bc a bc a d".split()
    h = content_hashes([w.encode() for w in words], np.array([0, 2, 3]), 3)
    assert [int(x) for x in h] == [xxhash.xxh3_64_intdigest(" ".join(words[i : i + 3])) for i in (0, 2, 3)]


def test_sharding(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sharding.op7_sharding(spark, sf).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_odd_rows(spark, odd, nothing, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 1)
    rows = sharding.assign_shards(sharding.described(odd), 3).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in range(3) for i in range(4)]
    assert sharding.assign_shards(sharding.described(nothing)).count() == 0
    sharding.write_shards(odd, str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd.count()


def test_communication_matrix():
    counts = [5, 0, 17, 100, 3]
    m = sharding.communication_matrix(counts, 8, 1)
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sharding.even(125, 8).tolist()
    means = np.mean([sharding.communication_matrix([40, 40], 2, s)[0, 0] for s in range(400)])
    assert abs(means - 20) < 0.5


def test_draws_of_any_size():
    """Chances as the formula says, and no fixed numbers for large populations."""
    rng = np.random.default_rng(1)
    for good, bad, drawn in ((5, 7, 6), (3, 40, 10), (30, 2, 20), (1, 1, 1), (4, 0, 3), (0, 4, 3), (6, 5, 0)):
        got = np.bincount([sharding.hypergeometric(rng, good, bad, drawn) for _ in range(6000)], minlength=drawn + 1) / 6000
        chance = [math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn) if drawn - k <= bad else 0 for k in range(drawn + 1)]
        assert np.abs(got - chance).max() < 0.03
    big = np.array([sharding.communication_matrix([5 * 10**8, 5 * 10**8], 8, s)[0] for s in range(60)], dtype=float)
    deviation = math.sqrt(5e8 / 8 * 7 / 8 * 0.5)
    assert (big.sum(axis=1) == 5e8).all() and 0.7 < big.std(axis=0).mean() / deviation < 1.3 and abs(big.mean() - 5e8 / 8) < deviation / 3
    assert sharding.communication_matrix([1_200_000_000, 5], 8, 1).sum() == 1_200_000_005
    assert 0 < sharding.hypergeometric(rng, 10**12, 7 * 10**12, 10**9) < 10**9


def test_places_are_uniform(spark):
    """Each row, and each of equal rows, takes each place about as often, over seeds; equal rows don't lie side by side."""
    rows = spark.createDataFrame([(i, 1, 1) for i in range(20)] + [(77, 1, 1)] * 10, "doc_id long, size long, text_crc32 long")
    first, apart = np.zeros((3, 10)), 0
    for seed in range(40):
        found = sharding.assign_shards(rows, 3, seed).collect()
        for r in found:
            first[r.shard, r.slot] += r.doc_id == 77
        slots = sorted((r.shard, r.slot) for r in found if r.doc_id == 77)
        apart += any(b[0] != a[0] or b[1] != a[1] + 1 for a, b in zip(slots, slots[1:], strict=False))
    assert first.sum() == 400 and apart >= 38
    assert abs(first - 400 / 30).max() < 5 * math.sqrt(400 / 30)


def test_large_table_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 50)
    rows = spark.range(4000).selectExpr("7L doc_id", "1L size", "1L text_crc32")
    found = sharding.assign_shards(rows, 4)
    assert sorted((r.shard, r.slot) for r in found.collect()) == [(s, i) for s in range(4) for i in range(1000)]

"""SimHash near-duplicates through sharded BK-trees.

Fingerprints within ``radius`` bits agree on at least one of radius + 1 bands of their bits, so every fingerprint is sent to
the shards of its bands, and each shard finds its links in a BK-tree: a child hangs on its parent by their Hamming distance,
and a search follows only edges within the radius. A shard with more than ``SHARD`` fingerprints is split again: its members
must agree on a band of the remaining bits, too. After ``SPLITS`` bands a shard that is still larger is searched by several tasks, each of which
has two of its parts, so no task holds more than twice ``SHARD`` fingerprints and no pair is lost. Trees are built where the shard's rows
are: they reach the queries by the exchange and not by a broadcast from the driver, which would have to hold all fingerprints. A shard
reports a spanning forest, not all pairs.

A search by similarity (``similar``) allows more bits than bands can be sure of. Its shards are bands of minimum hashes of the
shingle sets instead, whose chance to bring a pair together depends on the pair alone; a large shard is not split but searched by
several tasks, each of which has two of its parts. Its links are candidates only: the similarity of the shingle sets decides. Texts that
candidates join form a group. Up to ``GROUP`` of them are compared in one task; of a larger group all members are compared with its first one,
and those that aren't like it with all the others, again in tasks of two parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.common import arrow_batches, by_share, checkpointed, documents, rows_of, text_or_empty
from tradeloom.llm.components import components

SEED = 42
#: Fingerprints in a shard beyond which it is split by further bands, and how often at most.
SHARD = 2000
SPLITS = 3
#: Texts, and shingles of them, that one part of a group of candidates has (a single longer text is a part of its own).
GROUP, GROUP_SHINGLES = 256, 4_000_000
#: Shingles hashed at once.
AT_ONCE = 1 << 18
#: Ids are below this.
SPARE = 1 << 62
#: Minimum hashes in a band of a search by similarity, and the chance that a pair at the threshold meets in no band.
WIDTH = 4
MISSED = 1e-6
#: A search by similarity allows so many deviations of the bits in which a pair's fingerprints differ, and so much more than the law for
#: large sets says (of 4 and 5 shingles, 0.188 of the bits differ, not 0.151).
DEVIATIONS = 5
SMALL_SETS = 1.25

_UNSIGNED = (1 << 64) - 1

_BAND_SPREAD = np.random.default_rng(23).integers(0, 1 << 63, size=4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANE_SPREAD = [1, *(int(v) * 2 + 1 for v in np.random.default_rng(17).integers(1, 1 << 62, size=31))]


def shingle_hashes(text: str, size: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of lower-cased words, joined by one space, some at a time."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts words
    if not words:
        return
    if len(words) < size:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=SEED)], dtype=np.uint64)
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(words) - size + 1, AT_ONCE):
        a, b = starts[i : min(i + AT_ONCE, len(words) - size + 1)].tolist(), ends[i + size - 1 : i + size - 1 + AT_ONCE].tolist()
        yield np.fromiter((digest(joined[s:e], SEED) for s, e in zip(a, b, strict=True)), dtype=np.uint64, count=len(a))


def fingerprints(hashes: Iterable[np.ndarray], lanes: int = 1) -> list[int]:
    """64-bit fingerprints: a bit is set if it is set in over half the hashes. Lanes after the first remix the hashes."""
    ones, n = np.zeros((lanes, 64), dtype=np.int64), 0
    for h in hashes:
        n += len(h)
        for lane in range(lanes):
            if lane:
                h = h * np.uint64(_LANE_SPREAD[lane])
                h ^= h >> np.uint64(32)
            for i in range(0, len(h), 4096):
                bits = np.unpackbits(h[i : i + 4096].astype(">u8").view(np.uint8)).reshape(-1, 64)
                ones[lane] += bits.sum(axis=0, dtype=np.uint16)
    weights = [1 << (63 - i) for i in range(64)]
    return [sum(w for w, set_ in zip(weights, (2 * row > n).tolist(), strict=True) if set_) for row in ones]


def shingle_set(text: str, size: int) -> np.ndarray:
    """The distinct hashes of ``shingle_hashes``, sorted."""
    found = list(shingle_hashes(text, size))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def band_count(least: float) -> int:
    """Bands of ``WIDTH`` minima of which a pair of similarity ``least`` shares one, but for a chance of ``MISSED``."""
    return math.ceil(math.log(MISSED) / math.log1p(-(least**WIDTH))) if least < 1 else 1


def band_keys(shingles: np.ndarray, count: int) -> list[int]:
    """A key for each of ``count`` bands of ``WIDTH`` minimum hashes of a set; none for an empty set."""
    if not len(shingles):
        return []
    spread = _BAND_SPREAD[: count * WIDTH]
    least = np.full(len(spread), np.uint64(_UNSIGNED))
    for i in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[i : i + 1024, None] * spread).min(axis=0))
    return [xxhash.xxh64_intdigest(least[i * WIDTH : (i + 1) * WIDTH].tobytes(), seed=i) for i in range(count)]


def _as_long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprints(docs: DataFrame, size: int, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and lanes (array of longs) of every whole text. Null, empty and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("lanes", pa.list_(pa.int64()))])
        rows = ((d, [_as_long(v) for v in fingerprints(shingle_hashes(t, size), lanes)]) for d, t in rows_of(batches, "doc_id", "text"))
        yield from arrow_batches(rows, schema)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, lanes array<long>")


def with_sets(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, text_hash, digest (of the shingle set), and shingles (their number), lanes and keys of the set, of every whole text."""
    count = band_count(near.least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("digest", pa.binary()), ("shingles", pa.int64()), ("lanes", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())),
        ])
        found = ((d, x, shingle_set(t, near.size)) for d, x, t in rows_of(batches, "doc_id", "text_hash", "text"))
        rows = (
            (d, x, xxhash.xxh128_digest(h.tobytes()), len(h), [_as_long(v) for v in fingerprints([h], near.lanes)], [_as_long(k) for k in band_keys(h, count)])
            for d, x, h in found
        )
        yield from arrow_batches(rows, schema, lambda r: 128 + 8 * len(r[5]))

    slim = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return slim.mapInArrow(run, "doc_id long, text_hash long, digest binary, shingles long, lanes array<long>, keys array<long>")


def bands(bits: list[int], parts: int) -> list[list[int]]:
    """The bit positions in ``parts`` bands of nearly equal size."""
    cuts = np.linspace(0, len(bits), parts + 1).astype(int)
    return [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class BkTree:
    """Members are numbered in the order they came; edges[parent] maps a distance to the child."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> list[int]:
        """Returns the new member's ancestors."""
        values, edges, new = self.values, self.edges, len(self.values)
        values.append(value)
        edges.append({})
        at, path = 0, []
        while at != new:
            path.append(at)
            at = edges[at].setdefault((values[at] ^ value).bit_count(), new)
        return path

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Members at most ``radius`` bits away."""
        values, edges = self.values, self.edges
        left = [0] if values else []
        while left:
            at = left.pop()
            far = (values[at] ^ value).bit_count()
            if far <= radius:
                yield at
            for distance, child in edges[at].items():
                if far - radius <= distance <= far + radius:
                    left.append(child)


def forest(nodes: list[int], values: list[int], checks: list[tuple[int, ...]], reach: int, most: int) -> list[tuple[int, int]]:
    """Links that join the members of one shard as all links within ``reach`` bits would. checks: further bits of each member, of
    which two linked members may differ in ``most``."""
    tree, root, out = BkTree(), list(range(len(nodes))), []
    whole: list[int] = []  # a member of the class that all below a member belong to; -1 if they belong to several

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    stored, edges = tree.values, tree.edges
    for i, value in enumerate(values):
        mine = i
        left = [0] if stored else []
        while left:
            j = left.pop()
            if whole[j] >= 0 and top(whole[j]) == mine:
                continue  # nothing new below
            far = (stored[j] ^ value).bit_count()
            if far <= reach and (other := top(j)) != mine and sum((a ^ b).bit_count() for a, b in zip(checks[i], checks[j], strict=True)) <= most:
                root[max(mine, other)] = mine = min(mine, other)
                out.append((nodes[i], nodes[j]))
            left += [child for distance, child in edges[j].items() if far - reach <= distance <= far + reach]
        whole.append(i)
        for j in tree.add(value):
            if whole[j] >= 0 and top(whole[j]) != mine:
                whole[j] = -1
    return out


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _shard_links(reach: int, most: int):
    """Links in a stream of shards whose rows are next to one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shards():
            key, nodes, values, checks = None, [], [], []
            for k, n, v, c in rows_of(batches, "path", "node", "value", "checks"):
                if k != key:
                    if len(nodes) > 1:
                        yield nodes, values, checks
                    key, nodes, values, checks = k, [], [], []
                nodes.append(n)
                values.append(v & _UNSIGNED)
                checks.append(tuple(x & _UNSIGNED for x in c))
            if len(nodes) > 1:
                yield nodes, values, checks

        yield from arrow_batches((link for s in shards() for link in forest(*s, reach, most)), _EDGES)

    return run


def _sharded(rows: DataFrame, radius: int) -> DataFrame:
    """``rows`` (node, lane, value, checks) by shard: a key for each band; large shards are split by bands of their other bits. ``used`` numbers the
    bands chosen so far."""
    arms = radius + 1
    ready: list[DataFrame] = []
    level = rows.select("node", "value", "checks", F.col("lane").cast("long").alias("path"), F.lit(0).alias("used"))
    chosen: list[tuple[int, ...]] = [()]
    for depth in range(SPLITS):
        masks = [_as_long(sum(1 << b for b in part)) for used in chosen for part in bands(_left(list(range(64)), used, radius), arms)]
        dealt = level.withColumn("used", F.explode(F.sequence(F.col("used") * arms, F.col("used") * arms + radius)))
        mask = F.element_at(F.array(*map(F.lit, masks)), F.col("used") + 1)
        dealt = dealt.withColumn("path", F.xxhash64("path", F.col("used") % arms, F.col("value").bitwiseAND(mask)))  # shards that clash are searched as one
        large = checkpointed(dealt.groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") > SHARD))
        if large.isEmpty():
            return _all([*ready, dealt.select("path", "node", "value", "checks")])
        ready.append(dealt.join(large, "path", "left_anti").select("path", "node", "value", "checks"))
        level = dealt.join(large, "path")
        if depth == SPLITS - 1:
            return _all([*ready, _in_parts(level.withColumn("parts", F.ceil(F.col("n") / SHARD)))])
        level = level.drop("n")
        chosen = [(*used, i) for used in chosen for i in range(arms)]
    return _all(ready)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _in_parts(rows: DataFrame) -> DataFrame:
    """path, node, value, checks of ``rows`` (with parts: of the shard): every two parts of a shard are a shard."""
    dealt = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    key = F.when(F.col("parts") > 1, F.xxhash64("path", F.least("mine", "other"), F.greatest("mine", "other"))).otherwise(F.col("path"))
    return dealt.select(key.alias("path"), "node", "value", "checks")


def _left(bits: list[int], used: tuple[int, ...], radius: int) -> list[int]:
    """The bits that are not in the bands chosen so far."""
    for i in used:
        part = bands(bits, radius + 1)[i]
        bits = [b for b in bits if b not in part]
    return bits


@dataclass(frozen=True)
class Near:
    """What counts as a near copy.

    size: words in a shingle. radius: bits in which one of ``lanes`` fingerprints may differ. least: the similarity of a search by
    similarity, whose candidates may differ in ``reach`` bits of the first fingerprint and ``most`` bits of all.
    """

    size: int = 4
    radius: int = 4
    lanes: int = 1
    reach: int | None = None
    most: int | None = None
    least: float | None = None


def similar(least: float = 0.8, size: int = 5, lanes: int = 8) -> Near:
    """Texts whose shingle sets have a Jaccard similarity of ``least`` or more.

    Of the bits of such a pair's fingerprints a share of acos(2s / (1 + s)) / pi differs; candidates may differ in far more.
    """
    share = SMALL_SETS * math.acos(2 * least / (1 + least)) / math.pi
    reach, most = (math.ceil(n * share + DEVIATIONS * math.sqrt(n * share * (1 - share))) for n in (64, 64 * lanes))
    return Near(size=size, lanes=lanes, reach=reach, most=most, least=least)


def _met(prints: DataFrame) -> DataFrame:
    """``prints`` (node, lanes, keys) by shard: one for each key. Of a shard of more than ``SHARD`` every two parts are a shard, so no
    pair is lost."""
    dealt = prints.select(F.explode("keys").alias("path"), "node")
    counts = dealt.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
    shared = checkpointed(dealt.join(counts, "path").withColumn("parts", F.ceil(F.col("n") / SHARD)))  # fingerprints are sent of these only
    shared = shared.join(prints.select("node", F.col("lanes")[0].alias("value"), F.col("lanes").alias("checks")), "node")
    return _in_parts(shared)


def links(prints: DataFrame, near: Near) -> DataFrame:
    """u and v: links that join ``prints`` (node, lanes, and keys for a search by similarity: one row a node) as all links would."""
    if near.least is not None:
        shards = _met(prints).repartition("path").sortWithinPartitions("path", "node")
        return shards.mapInArrow(_shard_links(near.reach, near.most), "u long, v long")
    rows = prints.select("node", F.posexplode("lanes").alias("lane", "value"), F.array().cast("array<long>").alias("checks"))
    shards = _sharded(rows, near.radius).repartition("path").sortWithinPartitions("path", "node")
    return shards.mapInArrow(_shard_links(near.radius, 0), "u long, v long")


def _spare(by: str = "lanes") -> Column:
    """A node for rows without an id, beyond all ids."""
    return F.xxhash64(by).bitwiseAND(F.lit(SPARE // 2 - 1)) + SPARE


def classes(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, lanes and component_id (the smallest doc_id reachable through links, itself included) of every row.

    Rows of equal fingerprints are one node, named by the smallest doc_id; so copies don't meet in pairs. Texts without a
    word have fingerprint 0 and are linked like others. Null ids sort last: a class of null ids only has a null
    component_id. Repeated rows get equal values; an empty table gives an empty result.
    """
    found = checkpointed(with_fingerprints(docs, near.size, near.lanes))
    prints = checkpointed(found.groupBy("lanes").agg(F.min("doc_id").alias("first"), _spare().alias("spare"), F.count("*").alias("n")))
    nodes = prints.withColumn("node", F.coalesce("first", "spare"))
    joined = components(links(nodes.select("node", "lanes"), near))
    return _named(found, nodes, joined, "lanes")


def _named(found: DataFrame, nodes: DataFrame, joined: DataFrame, by: str) -> DataFrame:
    """``found`` with the component_id of its node, joined by the column ``by``."""
    named = nodes.join(joined, "node", "left").select(by, "n", F.when(F.coalesce("component", "node") < SPARE, F.coalesce("component", "node")).alias("component_id"))
    return by_share(found, named, by, "n", found.count())


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether sorted arrays of distinct values have a Jaccard similarity of ``least`` or more."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < least * len(b) - 1e-6:
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common / (len(a) + len(b) - common) >= least


def similar_classes(nodes: list[int], sets: list[np.ndarray], least: float, prints: list[int] | None = None, most: int = 0, known: list[bool] | None = None) -> Iterator[tuple[int, int]]:
    """Each node and the smallest node that it reaches through pairs of similarity ``least`` or more. prints: bits in which such a pair
    differs by ``most`` at most. known: nodes that are of one class already, whose pairs aren't looked at."""
    groups: list[list[int]] = []

    def meets(i: int, j: int) -> bool:
        if nodes[i] == nodes[j] or known and known[i] and known[j]:
            return True
        return (prints is None or (prints[i] ^ prints[j]).bit_count() <= most) and _alike(sets[i], sets[j], least)

    for i in range(len(nodes)):
        hits = [g for g in groups if any(meets(i, j) for j in reversed(g))]
        if hits:
            large = max(hits, key=len)
            for g in hits:
                if g is not large:
                    large += g
            groups = [g for g in groups if g is large or not any(g is h for h in hits)] if len(hits) > 1 else groups
            large.append(i)
        else:
            groups.append([i])
    for g in groups:
        first = min(nodes[i] for i in g)
        yield from ((nodes[i], first) for i in g)


_CLASSES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _one_print(lanes: list[int]) -> int:
    out = 0
    for lane in lanes:
        out = out << 64 | lane & _UNSIGNED
    return out


def _compared(rows: DataFrame, near: Near, with_first: bool = False) -> DataFrame:
    """u and v: links within each ``key`` of ``rows`` (key, node, text, lanes, known). with_first: all are compared with the first row (known) only,
    and u are those like it, v is it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one_by_one(members):
            lead = None
            for n, own, bits in members:
                if lead is None:
                    lead = (n, own, bits)
                elif n == lead[0] or (bits ^ lead[2]).bit_count() <= near.most and _alike(own, lead[1], near.least):
                    yield n, lead[0]

        def found():
            rows = ((k, n, shingle_set(t, near.size), _one_print(p), s) for k, n, t, p, s in rows_of(batches, "key", "node", "text", "lanes", "known"))
            for _, members in groupby(rows, lambda r: r[0]):
                if with_first:
                    yield from one_by_one((n, h, p) for _, n, h, p, _ in members)
                else:
                    _, nodes, sets, prints, known = zip(*members, strict=True)
                    yield from ((u, v) for u, v in similar_classes(nodes, sets, near.least, prints, near.most, known) if u != v)

        yield from arrow_batches(found(), _CLASSES)

    order = [F.col("known").desc()] if with_first else []
    return rows.repartition("key").sortWithinPartitions("key", *order, "node").mapInArrow(run, "u long, v long")


def _parts(n: str, shingles: str) -> Column:
    return F.greatest(F.ceil(F.col(n) / GROUP), F.ceil(F.col(shingles) / GROUP_SHINGLES), F.lit(1))


def _decided(texts: DataFrame, joined: DataFrame, near: Near) -> DataFrame:
    """u and v: links that join ``joined`` (node, component: of candidates, lanes, shingles; one row a node) as all pairs of similarity
    ``near.least`` within each component would. texts: node, text; several rows a node where texts of one shingle set have no id."""
    size = joined.groupBy("component").agg(F.count("*").alias("n"), F.sum("shingles").alias("shingles"))
    size = size.select("component", "n", _parts("n", "shingles").alias("parts"))
    sized = checkpointed(by_share(joined, size, "component", "n", joined.count()))
    small = sized.filter("parts = 1").select("node", "lanes", F.col("component").alias("key"), F.lit(False).alias("known"))
    within = _compared(texts.join(small, "node"), near)
    large = sized.filter("parts > 1")
    if large.isEmpty():
        return within

    # 1: each member with the group's first one, which is sent to each part
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    leads = large.filter("node = component").select("node", "lanes", "component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("known"))
    others = large.filter("node <> component").select("node", "lanes", "component", part.alias("part"), F.lit(False).alias("known"))
    rows = leads.unionByName(others).withColumn("key", F.xxhash64("component", "part")).select("key", "node", "lanes", "known")
    like_first = checkpointed(_compared(texts.join(rows, "node"), near, with_first=True))

    # 2: members that aren't like the first one with all the others, by two parts
    sure = like_first.select(F.col("u").alias("node")).distinct().withColumn("known", F.lit(True))
    marked = checkpointed(large.join(sure, "node", "left").withColumn("known", (F.col("node") == F.col("component")) | F.coalesce("known", F.lit(False))).withColumn("part", part))
    rest = marked.filter("not known").groupBy("component").agg(F.count("*").alias("__rest"), F.sum("shingles").alias("__shingles"))
    if rest.isEmpty():
        return within.unionByName(like_first)
    open_ = by_share(marked, rest.withColumn("rest_parts", _parts("__rest", "__shingles")).drop("__shingles"), "component", "__rest", marked.count())
    mine = F.pmod(F.xxhash64("node", F.lit(1)), F.col("rest_parts"))
    to_all = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: F.struct(mine.alias("r"), p.alias("p")))
    to_rest = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rest_parts") - 1), lambda r: F.struct(r.alias("r"), F.col("part").alias("p")))
    sent = open_.withColumn("to", F.explode(F.when(F.col("known"), to_rest).otherwise(F.array_union(to_all, to_rest))))
    pairs = sent.select(F.xxhash64("component", "to.r", "to.p").alias("key"), "node", "lanes", "known")
    return within.unionByName(like_first).unionByName(_compared(texts.join(pairs, "node"), near))


def near_classes(docs: DataFrame, near: Near, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, component_id (the smallest doc_id reachable through pairs of similarity ``near.least`` or more) and kept of every row.

    Candidates are found by fingerprints, each pair among the texts they join is decided by its shingle sets. Rows of equal sets are
    one node; null ids and repeated rows are as in ``classes``. kept: whether the row stays if one of each class does: those with the class's
    id, or, in a class without an id, those with its least text_hash.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = checkpointed(with_sets(slim, near))
    prints = found.groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.first("lanes").alias("lanes"), F.first("keys").alias("keys"), F.first("shingles").alias("shingles"), F.count("*").alias("n"), F.min("text_hash").alias("least_hash")
    )
    nodes = checkpointed(prints.withColumn("node", F.coalesce("first", _spare("digest"))).drop("first"))
    candidates = components(links(nodes.select("node", "lanes", "keys"), near))
    joined = checkpointed(candidates.join(nodes.groupBy("node").agg(F.first("lanes").alias("lanes"), F.sum("shingles").alias("shingles")), "node"))
    texts = slim.filter("doc_id IS NOT NULL").withColumnRenamed("doc_id", "node")
    if not found.filter("doc_id IS NULL").isEmpty():
        texts = texts.unionByName(_without_id(slim.filter("doc_id IS NULL"), near))
    exact = components(checkpointed(_decided(texts, joined, near)))

    named = nodes.join(exact, "node", "left").withColumn("class", F.coalesce("component", "node"))
    no_id = named.filter(F.col("class") >= SPARE)  # classes of texts without an id only
    lone = no_id.join(no_id.groupBy("class").agg(F.min("least_hash").alias("class_hash")), "class").select("digest", "n", F.lit(None).cast("long").alias("component_id"), "class_hash")
    named = named.filter(F.col("class") < SPARE).select("digest", "n", F.col("class").alias("component_id"), F.lit(None).cast("long").alias("class_hash")).unionByName(lone)
    out = by_share(found.select("doc_id", "text_hash", "digest"), named, "digest", "n", found.count())
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("text_hash") == F.col("class_hash"), F.lit(False))
    return out.select("doc_id", "text_hash", "component_id", kept.alias("kept"))


def _without_id(rows: DataFrame, near: Near) -> DataFrame:
    """node and text of rows without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((xxhash.xxh128_digest(shingle_set(t, near.size).tobytes()), t) for (t,) in rows_of(batches, "text"))
        yield from arrow_batches(found, pa.schema([("digest", pa.binary()), ("text", pa.string())]), lambda r: 64 + 4 * len(r[1]))

    return rows.select("text").mapInArrow(run, "digest binary, text string").select(_spare("digest").alias("node"), "text")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(documents(spark, sf_dir), Near(size=4, radius=4))
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("lanes")[0])), 16, "0").alias("fingerprint"), "component_id")

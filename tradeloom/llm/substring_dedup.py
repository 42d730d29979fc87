"""Substring dedup: windows of tokens that occur earlier are removed.

Every window of ``WINDOW`` words has a Rabin-Karp hash. Counting them all in Spark would shuffle one row a word, so windows are
counted in two steps, neither of which can lose one:

1. A window's anchor is the least hash of its ``ANCHOR``-word parts: equal windows have equal anchors, and neighbouring windows
   mostly share theirs. Anchors are counted; a window whose anchor occurs in one place only is unique.
2. The windows of repeated anchors are compared by anchor and by their Rabin-Karp hash joined (exclusive or) with a hash of their bytes, which
   are read again for it: two independent numbers of 64 bits in which windows of different words would have to agree. The first
   occurrence stays, all others are removed. Removed windows merge into maximal intervals of words.

Each task settles what it can see before the exchange: of each ``HELD`` windows it sends a repeated one once. So a passage that a third of
all documents share sends one row for every ``HELD`` windows of the corpus, not one a document. The texts are exchanged once; the
steps read the same exchange. Rows of one id and text are told apart by the input partition, so they aren't one key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeloom.llm.common import arrow_batches, documents, rows_of, text_or_empty
from tradeloom.llm.rolling import ANCHOR_BASE, WORD_BASE, content_hashes, mixed, running_least, windows, word_hashes

WINDOW = 20
ANCHOR = 8
#: Anchors or windows that a task holds before it settles and sends them on.
HELD = 2_000_000
#: Windows in one row of step 2.
RUN = 63

_LEAST_ID = -(1 << 63)


def parts_of(hashes: np.ndarray, window: int) -> np.ndarray:
    """The hash of every anchor-sized run of words of a text that has a window."""
    if len(hashes) < window:
        return np.zeros(0, dtype=np.uint64)
    return mixed(windows(hashes, min(ANCHOR, window), ANCHOR_BASE))


def anchors(parts: np.ndarray, window: int) -> np.ndarray:
    """The anchor of every window of words: its least part."""
    return running_least(parts, window - min(ANCHOR, window) + 1) if len(parts) else parts


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


_ANCHORS = pa.schema([("part", pa.int64()), ("anchor", pa.int64()), ("row", pa.int64()), ("weight", pa.int32())])


def _anchor_rows(window: int):
    """part, anchor, row, weight. weight 0: repeated within the task already; 1: once in it; 2: stands for one of weight 0."""

    def settled(found: list[np.ndarray], rows: list[int]) -> Iterator[pa.RecordBatch]:
        anchor = np.concatenate(found)
        row = np.repeat(np.array(rows, dtype=np.int64), list(map(len, found)))
        order = np.argsort(anchor, kind="stable")
        anchor, row = anchor[order], row[order]
        first = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        times = np.diff(np.append(np.flatnonzero(first), len(anchor)))
        many = np.repeat(times > 1, times)
        for mask, weight in ((~many, 1), (many, 0), (first & many, 2)):
            a, r = anchor[mask], row[mask]
            part = mixed(a ^ r.view(np.uint64)) if weight == 0 else a  # settled rows go anywhere
            for i in range(0, len(a), 200_000):
                s = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(part[s])), pa.array(_signed(a[s])), pa.array(r[s]), pa.array(np.full(len(a[s]), weight, dtype=np.int32))], schema=_ANCHORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows, held = [], [], 0
        for row, text in rows_of(batches, "row", "text"):
            parts = parts_of(word_hashes(text.encode().split())[0], window)
            if len(parts):
                every, times = np.unique(parts, return_counts=True)
                own = np.unique(anchors(parts, window))
                # a part that one text has twice is a repeated anchor by itself
                found.append(np.repeat(own, np.minimum(times[np.searchsorted(every, own)], 2)))
                rows.append(row)
                held += len(found[-1])
                if held >= HELD:
                    yield from settled(found, rows)
                    found, rows, held = [], [], 0
        if found:
            yield from settled(found, rows)

    return run


_WINDOWS = pa.schema([
    ("part", pa.int64()), ("anchor", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("mask", pa.int64()), ("hashes", pa.list_(pa.int64())),
])
_WINDOWS_DDL = "part long, anchor long, row long, doc_id long, start int, mask long, hashes array<long>"


def _window_rows(window: int):
    """Runs of windows with one anchor. With hashes: windows to be compared (mask: which ones); without: windows known to be
    removed."""

    def settled(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        sizes = [len(h[2]) for h in held]
        anchor, start, hashes = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))
        doc = np.repeat(np.arange(len(held)), sizes)
        unknown = np.array([h[0] is None for h in held])
        ids = np.array([_LEAST_ID if h[0] is None else h[0] for h in held], dtype=np.int64)
        rows = np.array([h[1] for h in held], dtype=np.int64)
        at = np.arange(len(anchor))

        order = np.lexsort((start, ids[doc], hashes, anchor))
        same = np.concatenate([[False], (anchor[order][1:] == anchor[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])])
        its = order[np.maximum.accumulate(np.where(same, 0, at))]  # the first of each group
        later = np.zeros(len(order), dtype=bool)  # the same place in a repeated row isn't later
        later[order] = (ids[doc[order]] != ids[doc[its]]) | (start[order] != start[its])

        fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
        fresh = (at - np.maximum.accumulate(np.where(fresh, at, 0))) % RUN == 0
        firsts = np.flatnonzero(fresh)
        bit = np.int64(1) << (at - np.maximum.accumulate(np.where(fresh, at, 0)))
        gone = np.bitwise_or.reduceat(np.where(later, bit, 0), firsts)
        stay = np.bitwise_or.reduceat(np.where(later, 0, bit), firsts)
        counts = np.add.reduceat((~later).astype(np.int64), firsts)

        def batch(chosen: np.ndarray, part: np.ndarray, mask: np.ndarray, lists: pa.Array) -> Iterator[pa.RecordBatch]:
            i = firsts[chosen]
            d = doc[i]
            columns = [part, _signed(anchor[i]), rows[d], pa.array(ids[d], pa.int64(), mask=unknown[d]), start[i], mask[chosen], lists]
            whole = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=_WINDOWS)
            for k in range(0, whole.num_rows, 50_000):
                yield whole.slice(k, 50_000)

        known = np.flatnonzero(gone)
        yield from batch(known, rows[doc[firsts[known]]] ^ start[firsts[known]], gone, pa.nulls(len(known), pa.list_(pa.int64())))
        open_ = np.flatnonzero(stay)
        ends = pa.array(np.concatenate([[0], np.cumsum(counts[open_])]).astype(np.int32))
        yield from batch(open_, _signed(anchor[firsts[open_]]), stay, pa.ListArray.from_arrays(ends, pa.array(_signed(hashes[~later]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for d, row, text, known in rows_of(batches, "doc_id", "row", "text", "anchors"):
            words = text.encode().split()
            for_parts, for_windows = word_hashes(words)
            anchor = anchors(parts_of(for_parts, window), window)
            at = np.flatnonzero(np.isin(anchor, np.array(known, dtype=np.int64).view(np.uint64)))
            if not len(at):
                continue
            held.append((d, row, anchor[at], at.astype(np.int32), mixed(windows(for_windows, window, WORD_BASE)[at]) ^ content_hashes(words, at, window)))
            total += len(at)
            if total >= HELD:
                yield from settled(held)
                held, total = [], 0
        if held:
            yield from settled(held)

    return run


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])
_KEPT_DDL = "doc_id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept string"


def intervals(starts: np.ndarray, window: int) -> np.ndarray:
    """Maximal intervals (start, end) covered by windows that begin at ``starts`` (ascending)."""
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    apart = np.flatnonzero(starts[1:] > starts[:-1] + window)
    return np.stack([starts[np.concatenate([[0], apart + 1])], starts[np.concatenate([apart, [len(starts) - 1]])] + window], axis=1)


def _removal(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(d, text, ids, starts, masks):
            words = text.encode().split()
            own = np.array([i == d for i in ids or ()], dtype=bool)
            run_at, offset = np.nonzero(np.array(masks or (), dtype=np.int64)[own][:, None] >> np.arange(RUN) & 1)
            spans = intervals(np.unique(np.array(starts or (), dtype=np.int64)[own][run_at] + offset), window)
            if not len(spans):
                return d, len(words), 0, [], b" ".join(words).decode()
            kept, at = [], 0
            for start, end in spans.tolist():
                kept += words[at:start]
                at = end
            kept += words[at:]
            return d, len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in spans.tolist()], b" ".join(kept).decode()

        rows = (row(*r) for r in rows_of(batches, "doc_id", "text", "ids", "starts", "masks"))
        yield from arrow_batches(rows, _KEPT, lambda r: len(r[4]) + 64)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, removed (maximal intervals of word numbers) and kept (words joined by one space).

    A word goes if a window over it also starts earlier: at a smaller doc_id (null ids come first), or earlier in the same
    document. Windows are judged on the input. Null and empty texts have no words; texts of fewer than ``window`` words stay
    whole; rows repeated under one doc_id start at the same place, so neither is the earlier one.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    # the row's key spreads copies over partitions; a clash of keys only adds candidates, as ids are compared, too
    base = slim.withColumn("row", F.xxhash64("doc_id", "text", F.spark_partition_id())).repartition("row")

    counted = base.mapInArrow(_anchor_rows(window), "part long, anchor long, row long, weight int").repartition("part")
    times = F.sum("weight").over(Window.partitionBy("part", "anchor"))
    repeated = counted.withColumn("times", times).filter("weight = 0 or (weight = 1 and times > 1)")
    known = repeated.groupBy("row").agg(F.collect_set("anchor").alias("anchors"))  # one document's own anchors

    # texts aren't sorted for these joins: one document's row on either side
    found = base.join(known.hint("shuffle_hash"), "row").select("doc_id", "row", "text", "anchors").mapInArrow(_window_rows(window), _WINDOWS_DDL).repartition("part")
    bits = F.filter(F.sequence(F.lit(0), F.lit(RUN - 1)), lambda i: F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    to_compare = F.when(F.col("hashes").isNotNull(), F.arrays_zip(bits.alias("bit"), F.col("hashes").alias("hash")))
    each = found.select("part", "anchor", "row", "doc_id", "start", "mask", F.explode_outer(to_compare).alias("w"))
    each = each.select(
        "part", "anchor", "row", "doc_id", (F.col("start") + F.coalesce(F.col("w.bit"), F.lit(0))).alias("start"), F.col("w.hash").alias("hash"),
        F.when(F.col("w.bit").isNull(), F.col("mask")).otherwise(F.lit(1)).alias("mask"),
    )
    order = Window.partitionBy("part", "anchor", "hash").orderBy(F.col("doc_id").asc_nulls_first(), "start")
    gone = each.withColumn("place", F.rank().over(order)).filter("hash is null or place > 1")
    merged = gone.groupBy("row").agg(F.collect_list(F.struct("doc_id", "start", "mask")).alias("gone"))

    merged = merged.select("row", F.col("gone.doc_id").alias("ids"), F.col("gone.start").alias("starts"), F.col("gone.mask").alias("masks"))
    return base.join(merged.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "ids", "starts", "masks").mapInArrow(_removal(window), _KEPT_DDL)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: A window's words are one string, put together by doubling.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), e AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS pos, unnest(words) AS word, len(words) AS n FROM d
), e2 AS (
  SELECT *, word || ' ' || lead(word, 1) OVER (PARTITION BY doc_id ORDER BY pos) AS two FROM e
), e4 AS (
  SELECT *, two || ' ' || lead(two, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS four FROM e2
), e8 AS (
  SELECT *, four || ' ' || lead(four, 4) OVER (PARTITION BY doc_id ORDER BY pos) AS eight FROM e4
), e20 AS (
  SELECT doc_id, pos, n,
         eight || ' ' || lead(eight, 8) OVER (PARTITION BY doc_id ORDER BY pos) || ' ' || lead(four, 16) OVER (PARTITION BY doc_id ORDER BY pos) AS twenty
  FROM e8
), g AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY sha256(twenty) ORDER BY doc_id, pos) AS place FROM e20 WHERE pos + 19 <= n
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM g WHERE place > 1
), kept AS (
  SELECT e.doc_id, count(*) AS n_words, count(gone.pos) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY e.pos) FILTER (WHERE gone.pos IS NULL), '') AS kept
  FROM e LEFT JOIN gone ON e.doc_id = gone.doc_id AND e.pos = gone.pos GROUP BY e.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

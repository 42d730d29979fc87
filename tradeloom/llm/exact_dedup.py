"""Exact dedup by a log-structured merge index of text digests, in DataFrame operations only.

* memtable: the rows of one input partition; each is sorted by digest and flushed as a run of one Parquet table in the shared folder, with
  min/max statistics.
* levels: runs are taken into the index ``BATCHES`` groups at a time, each as a level with one entry a digest, which keeps the group's size and the
  row that stays, and a filter: a bitmap of the digests' hashes.
* compaction: two levels of about one size merge. Each level's entries are probed with the other's filter; what passes neither is carried over as it
  is, and only the rest is exchanged and merged by digest, where the smallest identifier of the longest rows stays.
* hits: digests with more than one row. The documents behind them are found through a bitmap, too, and their normalised bytes are
  compared, after map-side aggregation, so that a group of any size sends one text a task. A digest shared by different texts is
  split by the texts themselves.

Filters have eight bits an entry, up to ``FILTER_BITS``; a fuller filter only lets more rows be exchanged and compared.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.common import WHITESPACE, by_share, documents, text_or_empty, written

#: Bits of a filter at least and at most: 128 KB to 8 MB as a broadcast, whatever the input's size.
LEAST_BITS, FILTER_BITS = 1 << 20, 1 << 26
#: Levels that the runs of one table are taken in by.
BATCHES = 2


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = text_or_empty(text)
    for ch in WHITESPACE:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def sha256_digest(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


@dataclass
class Level:
    """entries: digest, group_size, head(minus_chars, no_id, doc_id, seq). filter: bucket and bits of a bitmap of ``bits`` bits."""

    entries: DataFrame
    filter: DataFrame
    bits: int
    rows: int


@dataclass
class DedupIndex:
    """runs: seq, doc_id, digest, chars, text_sha256, of all ``rows`` rows. levels: the largest first."""

    runs: DataFrame
    levels: list[Level]
    rows: int

    @property
    def entries(self) -> DataFrame:
        """One entry a digest, of all levels."""
        return _whole(self.levels).entries


def flush(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Writes each partition's rows as a run sorted by digest."""
    norm = normalised(F.col(text_col))
    slim = docs.select(
        F.monotonically_increasing_id().alias("seq"), F.col(id_col).alias("doc_id"), norm.alias("norm"), F.char_length(text_or_empty(text_col)).alias("chars")
    ).select("seq", "doc_id", digest(F.col("norm")).alias("digest"), "chars", sha256_digest(F.col("norm")).alias("text_sha256"))
    return written(slim.sortWithinPartitions("digest"), "dedup-run")


def _head() -> Column:
    """The row that stays: most code points, then smallest id (null last), then first seen."""
    return F.min(F.struct((-F.col("chars")).alias("minus_chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "seq"))


def _slot(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(bits)) + 1


def bitmap(rows: DataFrame, key: str, bits: int) -> DataFrame:
    """A filter: bucket and bits (4 KB each) of the hashes of ``key``; at most ``bits`` / 32768 rows."""
    slots = rows.select(_slot(key, bits).alias("slot"))
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))


def probed(rows: DataFrame, key: str, found: DataFrame, bits: int) -> DataFrame:
    """``rows`` with ``maybe``: whether the filter has the hash of ``key``."""
    slotted = rows.withColumn("slot", _slot(key, bits)).withColumn("bucket", F.bitmap_bucket_number("slot"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(slot) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    joined = slotted.join(F.broadcast(found), "bucket", "left").withColumn("byte", F.coalesce(byte, F.lit(0)))
    return joined.withColumn("maybe", F.expr("(shiftright(byte, cast(bitmap_bit_position(slot) % 8 as int)) & 1) = 1")).select(*rows.columns, "maybe")


def _level(entries: DataFrame) -> Level:
    kept = written(entries, "dedup-level")
    rows = kept.count()
    bits = min(FILTER_BITS, max(LEAST_BITS, 1 << (8 * rows).bit_length()))
    return Level(kept, bitmap(kept, "digest", bits), bits, rows)


def merged(older: Level, newer: Level) -> Level:
    """One level of two: entries that the other's filter doesn't have are carried over, the others merge by digest."""
    columns = older.entries.columns
    sides = [probed(a.entries, "digest", b.filter, b.bits) for a, b in ((older, newer), (newer, older))]
    apart, both = (sides[0].filter(c).unionByName(sides[1].filter(c)).select(columns) for c in ("not maybe", "maybe"))
    return _level(apart.unionByName(both.groupBy("digest").agg(F.sum("group_size").alias("group_size"), F.min("head").alias("head"))))


def taken_in(levels: list[Level], runs: DataFrame) -> list[Level]:
    """``levels`` with one more, of the rows of ``runs``; levels merge while the last is at least half of the one before."""
    levels = [*levels, _level(runs.groupBy("digest").agg(F.count("*").alias("group_size"), _head().alias("head")))]
    while len(levels) > 1 and 2 * levels[-1].rows >= levels[-2].rows:
        levels[-2:] = [merged(*levels[-2:])]
    return levels


def compact(runs: DataFrame) -> DedupIndex:
    """Takes the runs in, by batches of input partitions."""
    levels: list[Level] = []
    for i in range(BATCHES):
        levels = taken_in(levels, runs.filter(F.pmod(F.shiftright("seq", 33), F.lit(BATCHES)) == i))
    return DedupIndex(runs, levels, runs.count())


def _whole(levels: list[Level]) -> Level:
    levels = list(levels)
    while len(levels) > 1:
        levels[-2:] = [merged(*levels[-2:])]
    return levels[0]


def lookup(index: DedupIndex, docs: DataFrame, text_col: str = "text", digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """The rows of ``docs``, a further batch, whose digest the index holds already, with ``keep_id``. Each level's filter is probed before its
    entries; digests are taken as proof."""
    new = docs.withColumn("__digest", digest(normalised(F.col(text_col))))
    hits = []
    for level in index.levels:
        maybe = probed(new.withColumnRenamed("__digest", "digest"), "digest", level.filter, level.bits).filter("maybe").drop("maybe")
        hits.append(maybe.join(level.entries.select("digest", "head"), "digest"))
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    least = found.groupBy(F.col("digest").alias("__digest")).agg(F.min("head").alias("head"))
    return new.join(least, "__digest").select(*docs.columns, F.col("head.doc_id").alias("keep_id"))


def _with_entries(runs: DataFrame, entries: DataFrame, rows: int) -> DataFrame:
    """runs with their entry; a row that the filter of hits doesn't have is its own entry and isn't exchanged."""
    hits = entries.filter("group_size > 1")
    bits = min(FILTER_BITS, max(LEAST_BITS, 1 << (8 * rows).bit_length()))
    sides = probed(runs, "digest", bitmap(hits, "digest", bits), bits)
    alone = sides.filter("not maybe").drop("maybe").withColumn("group_size", F.lit(1).cast("long")).withColumn("head", _own_head())
    sized = entries.withColumn("__n", F.col("group_size"))
    return alone.unionByName(by_share(sides.filter("maybe").drop("maybe"), sized, "digest", "__n", rows))


def _own_head() -> Column:
    return F.struct((-F.col("chars")).alias("minus_chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "seq")


def _maybe_hit(docs: DataFrame, grouped: DataFrame, rows: int) -> DataFrame:
    """The documents whose id may be one of those in groups of two or more."""
    bits = min(FILTER_BITS, max(LEAST_BITS, 1 << (8 * rows).bit_length()))
    return probed(docs, "doc_id", bitmap(grouped.filter("group_size > 1"), "doc_id", bits), bits).filter("maybe").drop("maybe")


def collisions(docs: DataFrame, grouped: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """Byte verification of hits: the digests that stand for more than one normalised text."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = _maybe_hit(slim, grouped, rows).select(normalised(F.col("text")).alias("norm")).select(digest(F.col("norm")).alias("digest"), "norm")
    variants = texts.groupBy("digest", "norm").agg(F.count("*").alias("n"))
    return variants.groupBy("digest").agg(F.count("*").alias("texts")).filter(F.col("texts") > 1).select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256, seq.

    Texts are equal when identical without white space; null and blank texts form one group. The row with the most code
    points stays, then the smallest doc_id (null ids last); of rows repeated in full exactly one is kept. An empty table
    gives an empty result; other columns are ignored.
    """
    index = compact(flush(docs, id_col, text_col, digest))
    grouped = _with_entries(index.runs, index.entries, index.rows)
    clashing = written(collisions(docs, grouped, index.rows, id_col, text_col, digest), "dedup-collisions")
    if not clashing.isEmpty():
        grouped = grouped.join(clashing, "digest", "left_anti").unionByName(_split_by_text(docs, index.runs, clashing, id_col, text_col))
    return grouped.select(
        "doc_id", F.col("head.doc_id").alias("keep_id"), "group_size", (F.col("seq") == F.col("head.seq")).alias("kept"), "text_sha256", "seq"
    )


def _split_by_text(docs: DataFrame, runs: DataFrame, clashing: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of clashing digests, grouped by their normalised texts."""
    suspects = runs.join(clashing, "digest", "left_semi")
    texts = docs.select(F.col(id_col).alias("__id"), normalised(F.col(text_col)).alias("norm")).distinct()
    with_text = suspects.join(texts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_sha256") == sha256_digest(F.col("norm"))))
    entries = with_text.groupBy("digest", "norm").agg(F.count("*").alias("group_size"), _head().alias("head"))
    return with_text.join(entries, ["digest", "norm"]).select(*runs.columns, "group_size", "head")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged.

    Rows whose id isn't in the filter of dropped rows stay without an exchange; the others are looked up by id and digest. Of rows that
    are alike in both, the longest stays.
    """
    found = written(exact_dedup(docs, id_col, text_col).select("doc_id", "text_sha256", "kept"), "dedup-kept")
    rows = found.count()
    bits = min(FILTER_BITS, max(LEAST_BITS, 1 << (8 * rows).bit_length()))
    gone = written(bitmap(found.filter("not kept"), "doc_id", bits), "dedup-gone")
    names = [f"__own{i}" for i in range(len(docs.columns))]  # so that no column's name clashes with those used here
    plain = docs.toDF(*names)
    id_name, text_name = (names[docs.columns.index(c)] for c in (id_col, text_col))
    sides = probed(plain, id_name, gone, bits)
    keep = found.filter("kept").select(F.struct("doc_id", "text_sha256").alias("key"))
    keyed = sides.filter("maybe").drop("maybe").withColumn("key", F.struct(F.col(id_name).alias("doc_id"), sha256_digest(normalised(F.col(text_name))).alias("text_sha256")))
    longest = F.max_by(F.struct(*names), F.struct(F.char_length(text_or_empty(text_name)), F.xxhash64(*names)))
    looked_up = keyed.groupBy("key").agg(longest.alias("row")).join(keep, "key").select("row.*")
    return sides.filter("not maybe").select(*names).unionByName(looked_up).toDF(*docs.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

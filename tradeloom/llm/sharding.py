"""Uniform sharding with exact sizes by a hypergeometric communication matrix.

1. The rows are written once to the shared folder, so that partitions stay as they are, and counted by partition.
2. The driver draws how many rows each partition sends to each shard: partition by partition, a multivariate hypergeometric
   sample of the places that are left. Row sums are the partitions' sizes and column sums the shards'. It holds one integer
   for each partition and shard, no rows.
3. Each task permutes its labels locally and draws a random key for each of its rows by their position, so equal rows have keys of
   their own. Rows are exchanged by shard and a chunk of keys of about ``CHUNK_ROWS`` rows and permuted again, by key, within chunks;
   slots follow from the chunks' counts. No task gets a whole shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeloom.llm.common import documents, shared_dir, text_or_empty

CHUNK_ROWS = 50_000
#: A draw looks at the values within so many deviations (and ``NEARBY`` places) of the likeliest; others have a chance below 1e-30 in all.
DEVIATIONS, NEARBY = 12, 40


def even(rows: int, shards: int) -> np.ndarray:
    """Shard sizes at most one apart."""
    return np.array([rows // shards + (j < rows % shards) for j in range(shards)], dtype=np.int64)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` places, of ``good`` and ``bad`` ones, are good. By inversion: neighbouring values' chances have a simple ratio,
    whatever the population, so only the values around the likeliest are summed."""
    least, most = max(0, drawn - bad), min(good, drawn)
    if least == most:
        return least
    total = good + bad
    likeliest = min(max((drawn + 1) * (good + 1) // (total + 2), least), most)
    deviation = math.sqrt(drawn * (good / total) * (bad / total) * (total - drawn) / (total - 1))
    reach = NEARBY + math.ceil(DEVIATIONS * deviation)
    first = max(least, likeliest - reach)
    k = np.arange(first, min(most, likeliest + reach), dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log((good - k) * (drawn - k) / ((k + 1) * (bad - drawn + k + 1))))])
    below = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(below, rng.random() * below[-1], side="right"))


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each partition (of ``counts`` rows) sends to each shard; columns sum to ``even`` shard sizes. Each row is a multivariate
    hypergeometric draw of the places left, one shard after another."""
    rng = np.random.default_rng(seed)
    matrix = np.zeros((len(counts), shards), dtype=np.int64)
    left = even(sum(counts), shards).tolist()
    for i, n in enumerate(counts):
        others = sum(left)
        for j in range(shards):
            others -= left[j]
            took = hypergeometric(rng, left[j], others, n)
            matrix[i, j] = took
            left[j], n = left[j] - took, n - took
    return matrix


def assign_shards(rows: DataFrame, shards: int = 8, seed: int = 7) -> DataFrame:
    """``rows`` (no column named shard, slot or beginning with __) with shard (int) and slot (long, gapless from 0 in a shard).

    Shard sizes differ by at most one row. Equal rows, repeated rows and rows of nulls are rows like any other; an empty
    table gives an empty one. Keep ``rows`` narrow: they are written once and shuffled twice.
    """
    spark = rows.sparkSession
    shared_dir(spark)
    # a checkpoint keeps partitions and the order in them, which a table's readers may not
    stable = rows.checkpoint(eager=True).withColumn("__part", F.spark_partition_id())
    counts = {r["__part"]: r["count"] for r in stable.groupBy("__part").count().collect()}  # one number a partition
    parts = sorted(counts)
    matrix = communication_matrix([counts[p] for p in parts], shards, seed)
    sent = spark.sparkContext.broadcast(dict(zip(parts, matrix, strict=True)))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: dict[int, np.ndarray] = {}
        draws: dict[int, np.random.Generator] = {}
        for b in batches:
            part = b.column(b.schema.get_field_index("__part")).to_numpy()
            out, key = np.zeros(len(part), dtype=np.int32), np.zeros(len(part), dtype=np.int64)
            for p in np.unique(part).tolist():
                mine = np.flatnonzero(part == p)
                if p not in labels:
                    labels[p] = np.random.default_rng([seed, p, 0]).permutation(np.repeat(np.arange(shards, dtype=np.int32), sent.value[p]))
                    draws[p] = np.random.default_rng([seed, p, 1])
                out[mine], labels[p] = labels[p][: len(mine)], labels[p][len(mine) :]
                key[mine] = draws[p].integers(-(1 << 63), 1 << 63, len(mine), dtype=np.int64)
            yield b.append_column("shard", pa.array(out, pa.int32())).append_column("__key", pa.array(key, pa.int64()))

    fields = [*stable.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("__key", T.LongType())]
    labelled = stable.mapInArrow(label, T.StructType(fields))
    chunks = max(1, -(-sum(counts.values()) // (shards * CHUNK_ROWS)))
    keyed = labelled.withColumn("__chunk", F.pmod(F.xxhash64("__key"), F.lit(chunks)))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("shard").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = keyed.groupBy("shard", "__chunk").agg(F.count("*").alias("__n")).withColumn("__before", before).drop("__n")
    at = F.row_number().over(Window.partitionBy("shard", "__chunk").orderBy("__key", F.xxhash64(*rows.columns)))
    return keyed.withColumn("__at", at).join(offsets, ["shard", "__chunk"]).select(*rows.columns, "shard", (F.col("__before") + F.col("__at") - 1).alias("slot"))


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and one; a null text has none) and text_crc32 of each row."""
    raw = text_or_empty(text_col).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 7) -> None:
    """Writes whole ``docs`` in folders shard=0, 1, ..., each file in slot order. Repeated rows go to places of their own."""
    same = Window.partitionBy("doc_id", "size", "text_crc32")
    placed = assign_shards(described(docs), shards, seed).withColumn("__copy", F.row_number().over(same.orderBy("shard", "slot")))
    raw = text_or_empty("text").cast("binary")
    keyed = docs.withColumn("size", (F.octet_length(raw) + 1).cast("long")).withColumn("text_crc32", F.crc32(raw))
    keyed = keyed.withColumn("__copy", F.row_number().over(same.orderBy("text")))
    on = [keyed["doc_id"].eqNullSafe(placed["doc_id"]), *[keyed[c] == placed[c] for c in ("size", "text_crc32", "__copy")]]
    out = keyed.join(placed, on).select(*[keyed[c] for c in docs.columns], placed["shard"], placed["slot"])
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(described(documents(spark, sf_dir)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

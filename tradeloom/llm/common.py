"""Helpers shared by the corpus operators: inputs, the shared work folder, and byte-level word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that every contract here treats as white space (fixed values).
WHITESPACE = " \t\n\x0b\x0c\r"

#: Bytes of one Arrow batch that an operator returns (about), and rows of one that it reads at a time: Spark's own batches
#: hold thousands of texts, which as Python objects would take several times their memory.
OUT_BYTES = 8 << 20
READ_ROWS = 256


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a local one of our own if this is a local session
    (tests), an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    set_by = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_by.isDefined():
        return set_by.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset, and executors share no other folder")
    made = tempfile.mkdtemp(prefix="tradeloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what ``written`` and ``checkpointed`` wrote within. Results must have been read, or written elsewhere, by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        removed(spark, *_SCRATCH.pop())


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that ``stored`` wrote."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, read back, and the table's path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: computed once, so that later stages don't depend on lost executors."""
    out, path = stored(df, name)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    return written(df, "step")


def by_share(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group (one row a ``key``) but ``size``, its number of rows. Groups with a thousandth of the ``total``
    rows or more (a thousand at most, so they can be broadcast) don't go through the exchange by ``key``."""
    least = max(1000, -(-total // 1000))
    heavy = F.broadcast(groups.filter(F.col(size) >= least).drop(size))
    light = groups.filter(F.col(size) < least).drop(size)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key))


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of record batches as tuples of these columns, made a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, READ_ROWS):
            part = batch.slice(at, READ_ROWS)
            yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def arrow_batches(rows: Iterator[tuple], schema: pa.Schema, size=lambda row: 64) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most about ``OUT_BYTES`` each (a single larger row is a batch of its own)."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= OUT_BYTES or len(held) >= 5_000:
            yield _batch(held, schema)
            held, total = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

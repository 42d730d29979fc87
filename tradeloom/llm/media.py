"""Media columns: documents kept as progressive JPEG streams, read back as payloads, RGB tensors and features."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm import jpeg
from tradeloom.llm.common import arrow_batches, documents, rows_of, text_or_empty

BLOCK = 64

_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_READ = pa.schema([
    *_MEDIA, ("payload", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("rgb", pa.binary()), ("feature", pa.string()),
])


_READ_DDL = "doc_id long, n_bytes long, media binary, payload binary, width int, height int, rgb binary, feature string"


def padded(raw: bytes) -> bytes:
    """Bytes 0 are appended up to a positive multiple of the block."""
    return raw + b"\0" * (-len(raw) % BLOCK if raw else BLOCK)


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel in thousandths, and checksum of the tensor."""
    h, w, _ = rgb.shape
    means = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 1000 // (h * w)
    return f"{w}x{h};{','.join(map(str, means.tolist()))};{zlib.crc32(rgb.tobytes()):08x}"


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8, without padding) and media of every whole text. Null and empty texts are one block of zeros;
    equal texts give equal streams; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raws = ((d, t.encode()) for d, t in rows_of(batches, "doc_id", "text"))
        yield from arrow_batches(((d, len(r), jpeg.store(padded(r))) for d, r in raws), _MEDIA, lambda r: len(r[2]) + 64)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """``media`` (doc_id, n_bytes, media) with payload, width, height, rgb (height x width x 3 unsigned bytes) and feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _read_rows(rows_of(batches, "doc_id", "n_bytes", "media"))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _READ_DDL)


def _read_rows(media: Iterator[tuple[int | None, int, bytes]]) -> Iterator[pa.RecordBatch]:
    def row(d, n, m):
        image = jpeg.Image(m)
        rgb = image.rgb()
        return d, n, m, jpeg.payload(image), image.width, image.height, rgb.tobytes(), feature(rgb)

    yield from arrow_batches((row(*r) for r in media), _READ, lambda r: len(r[2]) + len(r[3]) + len(r[6]) + 64)


def stored_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``stored`` and then ``read_back``, in one Python process a task: the columns of ``read_back``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raws = ((d, t.encode()) for d, t in rows_of(batches, "doc_id", "text"))
        yield from _read_rows((d, len(r), jpeg.store(padded(r))) for d, r in raws)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, _READ_DDL)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_and_read(documents(spark, sf_dir)).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{BLOCK}, {BLOCK})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )

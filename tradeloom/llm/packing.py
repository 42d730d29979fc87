"""Sum-of-squares online packing of token ids into sequences.

Each task packs the documents of its partition, one after another. A document of more than one window gives full windows
and a rest; the rest goes to the fill level that leaves the smallest sum of squared counts of partially filled windows,
tracked in an array with one count for each level. Sizes that find no partner leave windows open: beyond ``MOST_OPEN`` of them
the fullest are filled by cutting pieces off the emptiest until half as many are left, so a task holds at most ``MOST_OPEN`` windows of ids
(8 MB) whatever the partition's size. At the end of the partition the open windows fill one another in the same way, and the last one is cut at
powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.common import arrow_batches, documents, rows_of, text_or_empty
from tradeloom.llm.tokens import encoders

WINDOW = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Windows that a task holds open.
MOST_OPEN = 1024

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
_DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

#: doc_id, start, ids, doc_tokens
Piece = tuple[int | None, int, bytes, int]


def _cut(piece: Piece, tokens: int) -> tuple[Piece, Piece]:
    doc, start, ids, total = piece
    return (doc, start, ids[: 4 * tokens], total), (doc, start + tokens, ids[4 * tokens :], total)


def _tokens(piece: Piece) -> int:
    return len(piece[2]) // 4


class LevelPacker:
    """open[h]: the windows filled to h tokens; counts[h]: how many; n_open: how many in all."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.n_open = 0
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def place(self, piece: Piece) -> list[Piece] | None:
        """Puts a piece shorter than a window where the sum of squares grows least; returns a window that it fills."""
        size, counts = _tokens(piece), self.counts
        level, grows = 0, 2 * counts[size] + 1
        held = np.flatnonzero(counts[1 : self.window - size + 1]) + 1
        if len(held):
            change = 2 * (counts[held + size] - counts[held]) + 2
            if held[-1] == self.window - size:  # a full window no longer counts
                change[-1] = 1 - 2 * counts[held[-1]]
            best = len(held) - 1 - int(np.argmin(change[::-1]))  # the fullest of equals
            if change[best] <= grows:
                level = int(held[best])
        if level:
            pieces = self.open[level].pop()
            counts[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self._reopen(level + size, pieces)
        return None

    def _reopen(self, level: int, pieces: list[Piece]) -> None:
        self.counts[level] += 1
        self.n_open += 1
        self.open.setdefault(level, []).append(pieces)

    def drain(self, keep: int = 0) -> Iterator[list[Piece]]:
        """The open windows, the fullest first, filled from the emptiest ones, until at most ``keep`` are open; with 0 the last is cut at
        powers of two."""
        left = [w for h in sorted(self.open) for w in self.open[h]]
        self.open, self.counts[:], self.n_open = {}, 0, 0
        while len(left) > max(1, keep):
            full = left.pop()
            room = self.window - sum(map(_tokens, full))
            while room and left:
                piece = left[0].pop()
                taken, rest = _cut(piece, min(room, _tokens(piece)))
                full.append(taken)
                room -= _tokens(taken)
                if _tokens(rest):
                    left[0].append(rest)
                if not left[0]:
                    left.pop(0)
            if room:
                left.append(full)
                break
            yield full
        for pieces in left if keep else ():
            self._reopen(sum(map(_tokens, pieces)), pieces)
        for pieces in () if keep else left:
            rest = sum(map(_tokens, pieces))
            while rest:
                room = 1 << (rest.bit_length() - 1)
                rest -= room
                part: list[Piece] = []
                while room:
                    taken, after = _cut(pieces[0], min(room, _tokens(pieces[0])))
                    part.append(taken)
                    room -= _tokens(taken)
                    pieces[:1] = [after] if _tokens(after) else []
                yield part


def packed(docs: Iterator[tuple[int | None, bytes]], window: int = WINDOW, most_open: int = MOST_OPEN) -> Iterator[list[Piece]]:
    """Sequences (lists of pieces) of the documents (id, ids) in their order; documents without ids give nothing."""
    packer = LevelPacker(window)
    for doc, ids in docs:
        total = len(ids) // 4
        whole = total - total % window
        for at in range(0, whole, window):
            yield [(doc, at, ids[4 * at : 4 * (at + window)], total)]
        if total > whole and (done := packer.place((doc, whole, ids[4 * whole :], total))):
            yield done
        if packer.n_open > most_open:
            yield from packer.drain(most_open // 2)
    yield from packer.drain()


def pack(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces of ``tokens`` (doc_id, ids): doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Every id lies in exactly one piece; offsets are gapless in a sequence; sequence ids are unique, not gapless. Repeated
    rows are packed as often as they occur; null ids are kept; a document without ids gives no piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pieces(rows_of(batches, "doc_id", "ids"), window)

    return tokens.select("doc_id", "ids").mapInArrow(run, _DDL)


def _pieces(docs: Iterator[tuple[int | None, bytes]], window: int) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 40

    def rows():
        for n, sequence in enumerate(packed(docs, window)):
            offset = 0
            for doc, start, ids, total in sequence:
                yield doc, start, len(ids) // 4, ids, total, first + n, offset
                offset += len(ids) // 4

    yield from arrow_batches(rows(), PIECES, lambda r: len(r[3]) + 64)


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Tokenises whole texts (null: empty), adds the end id and packs, in one Python process a task; see ``pack``."""
    encoder = encoders(docs.sparkSession, path or public_tokenizers.path(TOKENIZER), END_ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        yield from _pieces(((d, encode(t)) for d, t in rows_of(batches, "doc_id", "text")), window)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInArrow(run, _DDL)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

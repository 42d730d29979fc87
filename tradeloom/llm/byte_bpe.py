"""Byte-level BPE by Aho-Corasick matching and backtracking.

Bytes are mapped to Latin-1 characters so that pyahocorasick finds, in one pass, the longest vocabulary entry at every
position. Encoding starts with longest matches and steps back to shorter ones where two adjacent tokens aren't compatible,
that is, where applying the merges to their joined bytes would not give just these two. Positions from which no completion
exists are marked, so the work is linear in the piece. Compatibility of pairs and whole pieces are memoised, both bounded.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.common import arrow_batches, documents, rows_of, text_or_empty
from tradeloom.llm.tokens import read_file

VOCABULARY = "byte_bpe_50k.tiktoken"
MEMO_PIECES = 200_000
MEMO_PIECE_CHARS = 48
MEMO_PAIRS = 300_000
#: Pieces of a text that are held at once.
AT_ONCE = 1 << 20


def read_ranks(content: bytes) -> list[bytes]:
    """Vocabulary entries by rank; ranks are gapless from 0."""
    found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in content.splitlines() if line.strip())}
    return [found[i] for i in range(len(found))]


class ByteBpe:
    def __init__(self, tokens: list[bytes], pattern: str = public_tokenizers.PATTERN):
        self.tokens = tokens
        self.find = regex.compile(pattern)
        self.rank = {t.decode("latin-1"): i for i, t in enumerate(tokens)}
        self.length = [len(t) for t in tokens]
        self.memo: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for text, i in self.rank.items():
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.shorter = [self._prefix(t.decode("latin-1")) for t in tokens]
        self._learn_merges()

    def _prefix(self, text: str) -> int:
        """The longest entry that is a proper prefix; -1 for single bytes."""
        return next((self.rank[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.rank), -1)

    def _learn_merges(self) -> None:
        """halves[t]: the two tokens that merge into t last (a byte: itself twice). merged: pair of tokens to the token."""
        self.halves: list[tuple[int, int]] = []
        self.merged: dict[int, int] = {}
        for i, token in enumerate(self.tokens):
            text, left, halves = token.decode("latin-1"), self.shorter[i], (i, i)
            while left >= 0:
                right = self.rank.get(text[self.length[left] :], i)
                if left < i and right < i and self._stay_apart(left, right):
                    halves = (left, right)
                    self.merged[left << 20 | right] = i
                    break
                left = self.shorter[left]
            self.halves.append(halves)

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves the boundary between them: no merge across it comes before those inside.

        Undoes the latest merge on either side, in turn, and looks for an earlier one across the boundary.
        """
        before = 1 << 40
        while True:
            across = self.merged.get(left << 20 | right)
            if across is not None and across < before:
                return False
            if left > right:
                undone, inner = left, self.halves[left][1]
                if inner != left:
                    before, left = undone, inner
                    continue
                undone, inner = right, self.halves[right][0]
                if inner == right:
                    return True
                before, right = undone + 1, inner
            else:
                undone, inner = right, self.halves[right][0]
                if inner != right:
                    before, right = undone + 1, inner
                    continue
                undone, inner = left, self.halves[left][1]
                if inner == left:
                    return True
                before, left = undone, inner

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._stay_apart(left, right)
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        text = piece.decode("latin-1")
        whole = self.rank.get(text)
        if whole is not None:
            return [whole]
        length, shorter, n = self.length, self.shorter, len(text)
        longest = [0] * n
        for end, token in self.automaton.iter(text):  # ends ascend, so the longest at a start comes last
            longest[end - length[token] + 1] = token
        can_end = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0 and not (can_end[at + length[token]] and (not out or self.compatible(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:  # nothing goes on from here; try the token before once more, now shorter
                can_end[at] = 0
                token = out.pop()
                at -= length[token]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        if len(text) <= AT_ONCE:
            return self._join(self.find.findall(text))
        pieces, out = (m.group() for m in self.find.finditer(text)), []
        while some := list(islice(pieces, AT_ONCE)):
            out.append(self._join(some))
        return b"".join(out)

    def _join(self, pieces: list[str]) -> bytes:
        memo = self.memo
        try:
            return b"".join([memo[p] for p in pieces])
        except KeyError:
            pass
        if len(memo) > MEMO_PIECES:
            memo.clear()
        out = []
        for p in pieces:
            found = memo.get(p)
            if found is None:
                found = np.array(self.encode_piece(p.encode()), dtype="<u4").tobytes()
                if len(p) <= MEMO_PIECE_CHARS:
                    memo[p] = found
            out.append(found)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_BOTH = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
_CODERS: dict[tuple[str, str], ByteBpe] = {}


def _coder(key: tuple[str, str], content) -> ByteBpe:
    if key not in _CODERS:
        _CODERS[key] = ByteBpe(read_ranks(content.value), key[1])
    return _CODERS[key]


def encoded(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every whole text. Null and empty texts have no ids; other columns are ignored."""
    content = docs.sparkSession.sparkContext.broadcast(read_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder((path, pattern), content)
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
        rows = ((d, coder.encode(t)) for d, t in rows_of(batches, "doc_id", "text"))
        yield from arrow_batches(rows, schema, lambda r: len(r[1]) + 64)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decoded(tokens: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``tokens`` (doc_id, ids) with the decoded bytes as column decoded."""
    content = tokens.sparkSession.sparkContext.broadcast(read_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder((path, pattern), content)
        rows = ((d, i, coder.decode(i)) for d, i in rows_of(batches, "doc_id", "ids"))
        yield from arrow_batches(rows, _BOTH, lambda r: len(r[1]) + len(r[2]) + 64)

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encoded`` and then ``decoded``, in one Python process a task: doc_id, ids and decoded."""
    content = docs.sparkSession.sparkContext.broadcast(read_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder((path, pattern), content)
        ids = ((d, coder.encode(t)) for d, t in rows_of(batches, "doc_id", "text"))
        yield from arrow_batches(((d, i, coder.decode(i)) for d, i in ids), _BOTH, lambda r: len(r[1]) + len(r[2]) + 64)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    both = round_trip(documents(spark, sf_dir), path)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )

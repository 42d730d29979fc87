"""Token ids of whole texts under a public tokenizer file, for packing."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.common import arrow_batches, rows_of, text_or_empty

#: Words remembered by one Python worker (twice as many while they are exchanged), and the longest of them in bytes.
MEMO_WORDS = 240_000
MEMO_BYTES = 48
#: Tokenizer files are read by the driver and broadcast; a larger file is refused.
MAX_FILE = 64 << 20

TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def read_file(path: str) -> bytes:
    if os.path.getsize(path) > MAX_FILE:
        raise ValueError(f"{path} is over {MAX_FILE} bytes")
    with open(path, "rb") as f:
        return f.read()


#: What a tokenizer file must say for words to be encoded one by one and plain ones by the model alone (fixed values).
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: A word of Latin letters and then ASCII punctuation, if any: the tokenizer cuts it into these two pieces.
PLAIN_WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)")


def byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class Memo(dict):
    """``memo[key]`` is ``make(key)``, remembered for at most twice ``most`` keys, none of them longer than ``longest``. When it is full its
    values become ``older``; what is asked for again moves back, so frequent keys stay, and rare ones go."""

    def __init__(self, make: Callable, most: int, longest: int = MEMO_BYTES):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest
        self.older: dict = {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > self.longest:
                return found
        if len(self) >= self.most:
            self.older = self.copy()
            self.clear()
        self[key] = found
        return found


class WordEncoder:
    """Ids as little-endian unsigned 32-bit integers. A tokenizer of the definition ``BY_WORD`` drops white space and never merges across
    it, so words between ASCII white space are encoded on their own and remembered. Plain words go to the tokenizer's model in lower
    case, without its regular expressions; all others through the whole tokenizer. So do whole texts under any other definition."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        spec = json.loads(definition)
        self.by_word = all(spec.get(k) == v for k, v in BY_WORD.items()) and not any(not t["special"] for t in spec.get("added_tokens", []))
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words = Memo(self._word, MEMO_WORDS)
        self.pieces = Memo(self._piece, MEMO_WORDS)

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(letters)])

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        plain = PLAIN_WORD.fullmatch(text) if len(word) <= MEMO_BYTES else None
        if plain is None:
            return self._whole(text)
        return self.pieces[plain[1].lower()] + (self.pieces[plain[2]] if plain[2] else b"")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, text.encode().split()))


_ENCODERS: dict[str, WordEncoder] = {}


def encoders(spark: SparkSession, path: str, end_id: int | None = None) -> Callable[[], Callable[[str], bytes]]:
    """For tasks: makes (once in a process) what gives a text's ids, with ``end_id`` last where it is given."""
    definition = spark.sparkContext.broadcast(read_file(path).decode())
    last = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def make() -> Callable[[str], bytes]:
        if path not in _ENCODERS:
            _ENCODERS[path] = WordEncoder(definition.value)
        encode = _ENCODERS[path].encode
        return lambda text: encode(text) + last

    return make


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every whole text, with ``end_id`` last where it is given.

    Null and empty texts have no ids of their own. Other columns are ignored.
    """
    encoder = encoders(docs.sparkSession, path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        yield from arrow_batches(((d, encode(t)) for d, t in rows_of(batches, "doc_id", "text")), TOKENS, lambda r: len(r[1]) + 64)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, ids binary")

"""Secret scans: fixed patterns, and a token-efficiency test that exposes random strings.

Random strings need many tokens of a vocabulary learned from ordinary text: a run of key characters with few characters a
token is reported, unless it is a digest of a known length, a UUID or a number. Runs of one case, and such runs joined by separators,
may be words, so fewer characters a token are asked of them the shorter they are. A run that is not random as a whole is judged by its
segments, too, each by itself and with as many of the next as make a run of the least length.
Byte-level checks (a class map and a search for a run of the least length) come first, so most texts meet no expression.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeloom.llm.common import READ_ROWS, arrow_batches, documents, rows_of, text_or_empty
from tradeloom.llm.tokens import read_file

#: Kinds in the order of their listing; the last is the method's own.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that aren't too short
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: The method's parameters: shortest run, and the characters a token below which a run counts as random.
LEAST_RUN = 16
MOST_RATIO = 2.2
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The same for a run of ``LEAST_RUN`` letters that may be a word, and what each further letter adds, up to MOST_RATIO.
WORD_RATIO, WORD_STEP = 1.55, 0.08
#: The same for the letters of a name of several segments, each by itself, and how many letters it must have.
SEGMENT_RATIO, LEAST_LETTERS = 1.6, 8

RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN)
#: Hex digits in digests of common functions (fixed values): MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Words of one case (a capital may lead) and numbers, joined by separators.
NAME = re.compile(r"[-+/_=]*([A-Za-z]?[a-z]+|[A-Z]+|[0-9]+)([-+/_=]+([A-Za-z]?[a-z]+|[A-Z]+|[0-9]+))*[-+/_=]*")
NUMBERS = re.compile(r"[-+/_=0-9]+")
LETTERS = re.compile(r"[A-Za-z]+")
SEGMENT = re.compile(r"[A-Za-z0-9]+")
KNOWN = re.compile(rf"(?<![A-Za-z0-9]){UUID.pattern}(?![A-Za-z0-9])")

_WORDS = (b"passw", b"secret", b"token", b"api")
_HEX_MAP = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_RUN_MAP = bytes(120 if b < 128 and (chr(b).isalnum() or chr(b) in "+/_=-") else 32 for b in range(256))

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, as kind, start and end in code points."""
    raw, found = text.encode(), []
    lower = raw.lower()
    if any(w in lower for w in _WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if b"AKIA" in raw:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if b"h" * LEAST_HEX in raw.translate(_HEX_MAP):
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


class RandomStrings:
    """The token-efficiency test under a rank file's vocabulary."""

    def __init__(self, ranks: bytes, most_ratio: float = MOST_RATIO):
        import tiktoken

        merges = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks.splitlines() if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.most_ratio = most_ratio

    def ratio(self, run: str) -> float:
        """Characters a token, of the whole run: the library's merges take little more than linear time."""
        return len(run) / len(self.encoding.encode_ordinary(run))

    def is_random(self, run: str) -> bool:
        if NUMBERS.fullmatch(run) or UUID.fullmatch(run) or len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run):
            return False
        letters = LETTERS.findall(run)
        word = not any(c.isdigit() for c in run) and sum(a.islower() != b.islower() for a, b in zip(run, run[1:], strict=False)) < 4
        if not word and not NAME.fullmatch(run):
            return self.ratio(run) < self.most_ratio
        if len(letters) == 1:
            return self.ratio(letters[0]) < min(self.most_ratio, WORD_RATIO + WORD_STEP * (len(letters[0]) - LEAST_RUN))
        total = sum(map(len, letters))
        return total >= LEAST_LETTERS and sum(len(w) / self.ratio(w) for w in letters) * SEGMENT_RATIO > total and self.ratio(run) < self.most_ratio

    def spans(self, text: str) -> list[Span]:
        if b"x" * LEAST_RUN not in text.encode().translate(_RUN_MAP):
            return []
        out = []
        for m in RUN.finditer(text):
            if not self.has_known(m[0]) and self.is_random(m[0]):
                out.append(("random", m.start(), m.end()))
            else:
                out += [("random", m.start() + a, m.start() + b) for a, b in self.within(m[0])]
        return out

    def has_known(self, run: str) -> bool:
        return bool(KNOWN.search(run)) or any(len(w) in DIGEST_LENGTHS and DIGEST.fullmatch(w) for w in SEGMENT.findall(run))

    def within(self, run: str) -> list[tuple[int, int]]:
        """Random parts of a run that isn't random as a whole, overlapping ones as one. Known identifiers part it."""
        known = [k.span() for k in KNOWN.finditer(run)]
        parts: list[list[tuple[int, int]]] = [[]]  # segments between known identifiers
        at = 0
        for m in SEGMENT.finditer(run):
            while at < len(known) and known[at][1] <= m.start():
                at += 1
                parts.append([])
            if at < len(known) and known[at][0] <= m.start():
                continue
            if len(m[0]) in DIGEST_LENGTHS and DIGEST.fullmatch(m[0]):
                parts.append([])
            else:
                parts[-1].append(m.span())
        found: list[tuple[int, int]] = []
        for segments in parts:
            j = 0
            for i, (start, end) in enumerate(segments):
                j = max(i, j)
                while j < len(segments) - 1 and segments[j][1] - start < LEAST_RUN:
                    j += 1
                stop = segments[j][1]
                if stop - start < LEAST_RUN or (start, stop) == (0, len(run)) or not self.is_random(run[start:stop]):
                    continue
                if j > i and any(b - a >= LEAST_RUN and not self.is_random(run[a:b]) for a, b in segments[i : j + 1]):
                    continue  # the last is long enough to be judged by itself
                if found and start <= found[-1][1]:
                    found[-1] = (found[-1][0], max(stop, found[-1][1]))
                else:
                    found.append((start, stop))
        return found


def all_spans(text: str, method: RandomStrings) -> list[Span]:
    """Base spans, and random strings outside them, by start and kind."""
    base = base_spans(text)
    more = [s for s in method.spans(text) if not any(b[1] <= s[1] and s[2] <= b[2] for b in base)]
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if end > at:
            if start >= at:
                out += [text[at:start], "[SECRET]"]
            at = end
    return "".join([*out, text[at:]])


_METHODS: dict[tuple[str, float], RandomStrings] = {}


def _method(path: str, ratio: float, content) -> RandomStrings:
    if (path, ratio) not in _METHODS:
        _METHODS[path, ratio] = RandomStrings(content.value, ratio)
    return _METHODS[path, ratio]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, path: str | None = None, most_ratio: float = MOST_RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end; code points, end exclusive) of every whole text. Null and empty texts have
    none; repeated rows are scanned each; other columns are ignored."""
    path = path or public_tokenizers.path(VOCABULARY)
    content = docs.sparkSession.sparkContext.broadcast(read_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        method, schema = _method(path, most_ratio, content), pa.schema([("doc_id", pa.int64()), ("spans", SPANS)])
        rows = ((d, [dict(zip(("kind", "start", "end"), s, strict=True)) for s in all_spans(t, method)]) for d, t in rows_of(batches, "doc_id", "text"))
        yield from arrow_batches(rows, schema)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def redacted(docs: DataFrame, path: str | None = None, most_ratio: float = MOST_RATIO, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret replaced in the text; rows without secrets, null texts included, stay as they are."""
    path = path or public_tokenizers.path(VOCABULARY)
    content = docs.sparkSession.sparkContext.broadcast(read_file(path))
    schema = T.StructType(docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        method = _method(path, most_ratio, content)
        for b in batches:
            at = b.schema.get_field_index(text_col)
            for i in range(0, b.num_rows, READ_ROWS):
                part = b.slice(i, READ_ROWS)
                texts = [t if t is None or not (s := all_spans(t, method)) else redact(t, s) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(run, schema)


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _joined(F.filter("spans", lambda s: s["kind"] != "random"))
    return scan(documents(spark, sf_dir)).select(
        "doc_id", _count("assign").alias("n_assign"), _count("access").alias("n_access"), _count("hex").alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )

"""Collocations: frequent phrases of two to five words whose parts meet more often than by chance, for each language.

1. Words are numbers: 64-bit hashes of language and word. Words in buckets of fewer than ``least`` occurrences can't be frequent; the others are
   written in text order, once, with their full strings. Two strings of one number would show there, and another seed is taken.
2. For phrases of two, three, four and five words in turn, each task sums hash buckets of those whose parts (the phrase without its last and
   without its first word) lie in full buckets. What lies in full buckets itself is passed on: no frequent phrase is lost (Apriori).
3. Distinct phrases that pass all this, and words, are the candidates. An eighth of the tasks lists its own first; then all tasks list what isn't
   among those, so that a frequent phrase isn't sent by each. A minimal perfect hash over them gives each a slot, with its words stored there.
   Candidates are dealt to blocks of bounded size by their hash; there is one block unless there are millions.
4. With one block at hand, each task looks up the phrases of its text, compares their words with those that are stored, and counts slots by
   bincount in a numpy array; arrays are summed in a tree.
5. A candidate's cuts are two other candidates: their counts are read by slot.
"""

from __future__ import annotations

import itertools
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeloom.llm.common import documents, rows_of, text_or_empty, written
from tradeloom.llm.perfect_hash import PerfectHash
from tradeloom.llm.rolling import mixed

WORDS = 5
LEAST = 100
TOP = 2000
FACTOR = 1000
#: Buckets: as many as there are words / SHARE, within these powers of two. Beyond, more candidates are only passed on to be counted.
SHARE, LEAST_BITS, MOST_BITS = 8, 20, 28
CHUNK_BITS = 20
#: Words (numbers) in a row of the written table, and phrases that a task holds before it hands on their buckets.
ROW_WORDS, HELD = 1 << 17, 1 << 21
#: Candidates of a block (about): 56 bytes each are broadcast.
BLOCK = 1 << 19
#: Arrays that one task of the tree sums.
FAN_IN = 16
#: Words of a language of which a task remembers the number.
REMEMBERED = 1 << 16
#: Words that a task knows to have listed.
LISTED = 1 << 19
#: One task in so many lists its candidates and words first. Of words, so many, of so many bytes at most, are told to the others.
FIRST, TOLD, TOLD_BYTES = 8, 1 << 17, 64
ODD = 0xC2B2AE3D27D4EB4F

#: Text bytes: capitals are lowered, all breaks are full stops, tabs are spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else ord(".") if chr(b) in ".,;:!?\n\x0b\x0c\r" else ord(" ") if b == 9 else b for b in range(256))
UNKNOWN = "und"


class Collision(Exception):
    """Two words, or two phrases, have one number."""


class Numbers(dict):
    """Numbers of a language's words; a break's is 0. ``new`` has the words that weren't remembered."""

    def __init__(self, lang: str, seed: int):
        super().__init__({b".": 0})
        self.seed = xxhash.xxh3_64_intdigest(lang.encode(), seed)
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        found = 0 if word == b"." else xxhash.xxh3_64_intdigest(word, self.seed) or 1
        self[word] = found
        self.new.append(word)
        return found


def tokens(text: str) -> list[bytes]:
    """Words, and a full stop for each break."""
    return text.encode().translate(_TABLE).replace(b".", b" . ").split()


def numbered(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """Language, words that weren't met lately, and the numbers of all words of each text."""
    known: dict[str, Numbers] = {}
    for lang, text in rows_of(batches, "lang", "text"):
        if lang not in known:
            if len(known) >= 16:
                known.clear()
            known[lang] = Numbers(lang, seed)
        found, numbers = tokens(text), known[lang]
        numbers.new = []
        codes = np.fromiter(map(numbers.__getitem__, found), dtype=np.uint64, count=len(found))
        yield lang, numbers.new, codes


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers, most of them small: their lowest bytes, then the next ones and so on, as Huffman codes."""
    size, coder = numbers.itemsize, zlib.compressobj(1, strategy=zlib.Z_RLE)
    return coder.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), size).T)) + coder.flush()


def _spread(raw: bytes, kind: np.dtype | type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def _gaps(at: np.ndarray) -> bytes:
    """Ascending places as steps, which compress well; the first byte says how wide they are."""
    steps = np.diff(at, prepend=np.uint32(0))
    wide = bool(steps.max(initial=0) > 0xFFFF)
    return bytes([wide]) + _squeezed(steps.astype(np.uint32 if wide else np.uint16))


def _places(raw: bytes) -> np.ndarray:
    return np.cumsum(_spread(raw[1:], np.uint32 if raw[0] else np.uint16), dtype=np.int64)


class Buckets:
    """Sums of hash buckets of one task, capped at ``least`` each (more doesn't matter), handed on in chunks of 2^20 buckets."""

    schema = pa.schema([("chunk", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])
    DDL = "chunk int, at binary, n binary"

    def __init__(self, bits: int, least: int):
        self.shift, self.least = np.uint64(64 - bits), least
        self.held: list[np.ndarray] = []
        self.total = 0

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((hashes >> self.shift).astype(np.uint32))
        self.total += len(hashes)
        if self.total >= HELD:
            yield from self.handed_on()

    def handed_on(self) -> Iterator[pa.RecordBatch]:
        if not self.total:
            return
        at, n = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.total = [], 0
        n = np.minimum(n, self.least).astype(np.uint32)
        chunks, first = np.unique(at >> np.uint32(CHUNK_BITS), return_index=True)
        ends = [*first[1:].tolist(), len(at)]
        at &= np.uint32((1 << CHUNK_BITS) - 1)
        rows = [(int(c), _gaps(at[a:b]), _squeezed(n[a:b].astype(np.min_scalar_type(self.least)))) for c, a, b in zip(chunks, first.tolist(), ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.schema, strict=True)], schema=self.schema)


def full(partial: DataFrame, bits: int, least: int) -> np.ndarray:
    """The buckets that reach ``least``, as bits. Each chunk is summed by one task; 128 KB of it come to the driver, 32 MB in all at most."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for chunk, at, n in rows_of(batches, "chunk", "at", "n"):
            total = sums.setdefault(chunk, np.zeros(1 << CHUNK_BITS, dtype=np.uint32))
            at = _places(at)
            total[at] = np.minimum(total[at] + _spread(n, np.min_scalar_type(least)), least)
        for chunk, total in sums.items():
            raw = np.packbits(total >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([raw], pa.binary())], names=["chunk", "bits"])

    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    size = (1 << CHUNK_BITS) // 8
    for r in partial.repartition(1 << (bits - CHUNK_BITS), "chunk").mapInArrow(summed, "chunk int, bits binary").collect():
        out[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def lies_in(bitmap: np.ndarray, hashes: np.ndarray, shift: np.uint64) -> np.ndarray:
    at = hashes >> shift
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def phrases(v: np.ndarray, bitmaps: list[np.ndarray], shift: np.uint64, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For one to ``words`` words: places in ``v`` of phrases whose parts may be frequent, and their hashes. ``bitmaps`` are those of two words on."""
    at = np.flatnonzero(v)
    g = v[at]
    for k in range(1, words + 1):
        if k > 1:
            both = np.flatnonzero(np.diff(at) == 1)  # the phrases of k - 1 words here and at the next place
            at = at[both]
            g = mixed(g[both] * np.uint64(ODD) + v[at + k - 1])
            if k - 2 < len(bitmaps):
                keep = lies_in(bitmaps[k - 2], g, shift)
                at, g = at[keep], g[keep]
        yield k, at, g


def _packed(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers as their distinct values and the place of each: a third of the bytes, and few values for Spark to carry."""
    distinct, at = np.unique(codes, return_inverse=True)
    return distinct.tobytes(), at.astype(np.uint16 if len(distinct) <= 1 << 16 else np.uint32).tobytes()


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    for b in batches:
        for row in zip(*(b.column(b.schema.get_field_index(c)) for c in ("lang", "values", "codes")), strict=True):
            lang, distinct, at = (x.as_py() for x in row)
            distinct = np.frombuffer(distinct, dtype=np.uint64)
            yield lang, distinct[np.frombuffer(at, dtype=np.uint16 if len(distinct) <= 1 << 16 else np.uint32)]


def encoded(docs: DataFrame, seed: int, bits: int, least: int) -> DataFrame:
    """lang, n (words), values and codes (``_packed`` numbers in text order; 0 for breaks and words that can't be frequent) and words (number and
    string of words that the task hadn't met lately)."""
    sc = docs.sparkSession.sparkContext

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Buckets(bits, least)
        for _, _, codes in numbered(batches, seed):
            yield from sums.add(codes[codes != 0])
        yield from sums.handed_on()

    hot = sc.broadcast(full(docs.mapInArrow(count, Buckets.DDL), bits, least))
    word_type = pa.list_(pa.struct([("code", pa.int64()), ("word", pa.string())]))
    schema = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("values", pa.binary()), ("codes", pa.binary()), ("words", word_type)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - bits)
        held: dict[str, list] = {}  # by language: words so far, codes, new words, number of codes
        listed: set[int] = set()

        def row(lang: str) -> pa.RecordBatch:
            n, codes, new, _ = held.pop(lang)
            row = (lang, n, *_packed(np.concatenate(codes)), new)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for lang, met, codes in numbered(batches, seed):
            mine = held.setdefault(lang, [0, [], [], 0])
            mine[0] += int(np.count_nonzero(codes))
            codes = np.where(lies_in(hot.value, codes, shift), codes, np.uint64(0))
            if met:
                own = xxhash.xxh3_64_intdigest(lang.encode(), seed)
                number = np.fromiter((0 if w == b"." else xxhash.xxh3_64_intdigest(w, own) or 1 for w in met), dtype=np.uint64, count=len(met))
                for i in np.flatnonzero(lies_in(hot.value, number, shift) & (number != 0)).tolist():
                    pair = xxhash.xxh3_64_intdigest(met[i], int(number[i]))  # of number and word, as other words may have this number
                    if pair not in listed:
                        listed.add(pair)
                        mine[2].append({"code": int(number[i : i + 1].view(np.int64)[0]), "word": met[i].decode()})
                if len(listed) > LISTED:
                    listed.clear()
            codes = np.append(codes, np.uint64(0))
            mine[1].append(codes[(codes != 0) | np.append(True, codes[:-1] != 0)])  # one break of each run
            mine[3] += len(mine[1][-1])
            if mine[3] >= ROW_WORDS:
                yield row(lang)
            elif len(held) > 64:
                yield row(next(iter(held)))
        for lang in list(held):
            yield row(lang)

    return written(docs.mapInArrow(encode, "lang string, n long, values binary, codes binary, words array<struct<code: long, word: string>>"), "encoded")


def _distinct(batches: Iterator[pa.RecordBatch], bitmaps, shift: np.uint64, known: Block | None = None) -> Iterator[pa.RecordBatch]:
    """Distinct phrases of each row that may be frequent and aren't stored in ``known``."""
    names = ["lang", "k", "g", *(f"w{i}" for i in range(WORDS))]
    for lang, v in _codes(batches):
        for k, at, g in phrases(v, bitmaps, shift, WORDS):
            _, first, same = np.unique(g, return_index=True, return_inverse=True)
            words = [v[at + i].view(np.int64) for i in range(k)]
            other = np.any([w != w[first][same] for w in words], axis=0) if len(at) else np.zeros(0, dtype=bool)
            rows = np.concatenate([first, np.flatnonzero(other)])  # phrases of one hash are all kept
            if known is not None and len(rows):
                rows = rows[known.found(g[rows], np.stack([w[rows].view(np.uint64) for w in words], axis=1)) < 0]
            if len(rows):
                columns = [pa.array([lang] * len(rows), pa.string()), pa.array(np.full(len(rows), k, dtype=np.int32)), pa.array(g[rows].view(np.int64))]
                columns += [pa.array(words[i][rows] if i < k else np.zeros(len(rows), dtype=np.int64)) for i in range(WORDS)]
                yield pa.RecordBatch.from_arrays(columns, names=names)


WORD_COLUMNS = [f"w{i}" for i in range(WORDS)]
CANDIDATES = "lang string, k int, g long, " + ", ".join(f"{w} long" for w in WORD_COLUMNS)


def _first(table: DataFrame) -> DataFrame:
    """The rows of one task in ``FIRST``."""
    return table.filter(F.spark_partition_id() % FIRST == 0)


def _alike(rows: DataFrame, number: str) -> bool:
    return bool(rows.groupBy(number).count().filter("count > 1").limit(1).count())


def candidates(table: DataFrame, bits: int, least: int, block_size: int = BLOCK):
    """lang, k, g (hash) and the words' numbers of every phrase of up to five words that may be frequent; and what filtered them, broadcast."""
    sc, shift = table.sparkSession.sparkContext, np.uint64(64 - bits)
    text = table.select("lang", "values", "codes")
    bitmaps: list[np.ndarray] = []
    for words in range(2, WORDS + 1):
        sent = sc.broadcast(bitmaps)

        def count(batches: Iterator[pa.RecordBatch], words=words, sent=sent) -> Iterator[pa.RecordBatch]:
            sums = Buckets(bits, least)
            for _, v in _codes(batches):
                *_, (_, _, g) = phrases(v, sent.value, shift, words)
                yield from sums.add(g)
            yield from sums.handed_on()

        bitmaps = [*bitmaps, full(text.mapInArrow(count, Buckets.DDL), bits, least)]
    sent = sc.broadcast(bitmaps)
    first = written(_first(text).mapInArrow(lambda batches: _distinct(batches, sent.value, shift), CANDIDATES).distinct(), "first")
    if _alike(first, "g"):
        raise Collision
    made, several = blocks(first, block_size)
    known = sc.broadcast(pickle.loads(row.made) if (row := made.first()) else None)  # one block at most
    both = first.union(text.mapInArrow(lambda batches: _distinct(batches, sent.value, shift, known.value), CANDIDATES).distinct())
    found = written(both.distinct() if several else both, "candidates")
    known.destroy()
    return found, sent


def words_of(table: DataFrame, found: DataFrame, bits: int) -> DataFrame:
    """lang, code and word of the words of candidates of two words or more: others are in no result. Two strings of one number are both there."""
    shift = np.uint64(64 - bits)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Buckets(bits, 1)
        for b in batches:
            for w in WORD_COLUMNS:
                codes = b.column(b.schema.get_field_index(w)).to_numpy().view(np.uint64)
                yield from marks.add(codes[codes != 0])
        yield from marks.handed_on()

    sc = table.sparkSession.sparkContext
    sent = sc.broadcast(full(found.filter("k > 1").select(*WORD_COLUMNS).mapInArrow(mark, Buckets.DDL), bits, 1))

    def pick(batches: Iterator[pa.RecordBatch], told) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(b.schema.get_field_index("words"))
            lang = b.column(b.schema.get_field_index("lang"))
            code, word = words.flatten().field("code"), words.flatten().field("word")
            keep = pa.array(lies_in(sent.value, code.to_numpy().view(np.uint64), shift))
            of, code, word = (x.filter(keep) for x in (lang.take(pc.list_parent_indices(words)), code, word))
            new = pa.array([told.value.get(c) != w for c, w in zip(code.to_pylist(), word.to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([x.filter(new) for x in (of, code, word)], names=["lang", "code", "word"])

    def listed(rows: DataFrame, told: dict[int, str]) -> DataFrame:
        given = sc.broadcast(told)
        return rows.select("lang", "words").mapInArrow(lambda batches: pick(batches, given), "lang string, code long, word string").distinct()

    first = written(listed(_first(table), {}), "first")
    told = first.filter(F.octet_length("word") <= TOLD_BYTES).select("code", "word").limit(TOLD)
    return written(first.union(listed(table, {r.code: r.word for r in told.collect()})).distinct(), "words")


class Block:
    """A share of the candidates: their slots, the words stored there, and later their counts."""

    def __init__(self, langs: list[str], lang: np.ndarray, k: np.ndarray, g: np.ndarray, words: np.ndarray):
        """``lang``: places in ``langs``."""
        self.hash = PerfectHash(g)
        at = np.empty(len(g), dtype=np.int64)
        at[self.hash.slots(g)] = np.arange(len(g))
        self.langs, self.lang, self.k, self.words = langs, lang[at], k[at].astype(np.int8), np.ascontiguousarray(words[at])
        self.counts = np.zeros(len(g), dtype=np.int64)

    def found(self, g: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Slots of phrases of ``words.shape[1]`` words; -1 for those that aren't stored."""
        slot = self.hash.slots(g)
        k = words.shape[1]
        ok = slot >= 0
        ok[ok] = (self.k[slot[ok]] == k) & (self.words[slot[ok], :k] == words[ok]).all(axis=1)
        return np.where(ok, slot, -1)


def hashes(words: np.ndarray) -> np.ndarray:
    """Of phrases, one a row, as ``phrases`` has them."""
    g = words[:, 0]
    for i in range(1, words.shape[1]):
        g = mixed(g * np.uint64(ODD) + words[:, i])
    return g


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pickled block for each number of a block in the partition."""
    held: dict[int, list[pa.RecordBatch]] = {}
    for b in batches:
        block = b.column(b.schema.get_field_index("block")).to_numpy()
        for x in np.unique(block).tolist():
            held.setdefault(x, []).append(b.filter(pa.array(block == x)))
    for x in list(held):
        t = pa.Table.from_batches(held.pop(x))
        words = np.stack([t[w].to_numpy().view(np.uint64) for w in WORD_COLUMNS], axis=1)
        lang = t["lang"].combine_chunks().dictionary_encode()
        lang = lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
        made = Block(lang.dictionary.to_pylist(), lang.indices.to_numpy(), t["k"].to_numpy(), t["g"].to_numpy().view(np.uint64), words)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()), pa.array([pickle.dumps(made)], pa.large_binary()).cast(pa.binary())], names=["block", "made"])


def blocks(found: DataFrame, size: int) -> tuple[DataFrame, int]:
    """The candidates in blocks of about ``size``, built by one task each, and the bits of a hash that tell the block."""
    total = found.count()
    bits = max(0, (-(-total // size) - 1).bit_length())
    block = F.shiftrightunsigned("g", 64 - bits).cast("int") if bits else F.lit(0)
    return written(found.withColumn("block", block).repartitionById(1 << bits, F.col("block")).mapInArrow(_built, "block int, made binary"), "blocks"), bits


def _block_of(g: np.ndarray, bits: int) -> np.ndarray:
    return (g >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(g), dtype=np.int64)


def counted(text: DataFrame, block: Block, number: int, bits: int, filters=None, shift: np.uint64 = np.uint64(0)) -> np.ndarray:
    """Occurrences of a block's candidates by slot: one array a task, summed in a tree. What the ``filters`` of ``candidates`` don't pass isn't looked
    up."""
    sent, size = text.sparkSession.sparkContext.broadcast(block), len(block.k)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for _, v in _codes(batches):
            for k, at, g in phrases(v, filters.value if filters else [], shift, WORDS):
                mine = np.flatnonzero(_block_of(g, bits) == number) if bits else slice(None)
                at, g = at[mine], g[mine]
                slot = sent.value.hash.slots(g)
                maybe = np.flatnonzero(slot >= 0)
                at, slot = at[maybe], slot[maybe]
                ok = sent.value.k[slot] == k
                for i in range(k):
                    ok &= sent.value.words[slot, i] == v[at + i]
                total += np.bincount(slot[ok], minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array([_squeezed(total)], pa.binary())], names=["counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for (raw,) in rows_of(batches, "counts"):
            total += _spread(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([_squeezed(total)], pa.binary())], names=["counts"])

    arrays, left = text.mapInArrow(count, "counts binary"), text.rdd.getNumPartitions()
    while left > 1:  # a tree: every task sums a few arrays
        left = -(-left // FAN_IN)
        arrays = arrays.repartition(left).mapInArrow(summed, "counts binary")
    out = np.zeros(size, dtype=np.int64)
    for r in arrays.collect():  # one row
        out += _spread(r.counts, np.int64)
    sent.destroy()
    return out


PHRASES = "lang string, k int, words array<long>, a long, parts array<long>"


def frequent(spark: SparkSession, block: Block, least: int) -> DataFrame:
    """lang, k, words, a (count) of a block's frequent phrases, and parts: the counts of the first 1, 2, ... words and of the rest, unknown yet."""
    sent, tasks = spark.sparkContext.broadcast(block), 16

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (i,) in rows_of(batches, "id"):
            b = sent.value
            slots = np.arange(i, len(b.k), tasks)
            slots = slots[(b.counts[slots] >= least) & (b.k[slots] > 1)]
            for j in range(0, len(slots), 10_000):
                s = slots[j : j + 10_000]
                words = [b.words[x, : b.k[x]].view(np.int64).tolist() for x in s.tolist()]
                columns = [pa.array([b.langs[x] for x in b.lang[s].tolist()], pa.string()), pa.array(b.k[s].astype(np.int32)), pa.array(words, pa.list_(pa.int64())), pa.array(b.counts[s])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([[0] * (2 * len(w) - 2) for w in words], pa.list_(pa.int64()))], names=["lang", "k", "words", "a", "parts"])

    return spark.range(0, tasks, 1, tasks).mapInArrow(rows, PHRASES)


def with_parts(found: DataFrame, block: Block, number: int, bits: int) -> DataFrame:
    """``found`` with the counts of those parts that are in this block, read by slot."""
    sent = found.sparkSession.sparkContext.broadcast(block)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks = b.column(1).to_numpy()
            words, parts = b.column(2).to_pylist(), b.column(4).to_pylist()
            for k in np.unique(ks).tolist():
                rows = np.flatnonzero(ks == k)
                w = np.array([words[r] for r in rows.tolist()], dtype=np.int64).view(np.uint64)
                for cut in range(1, k):
                    for side, part in enumerate((w[:, :cut], w[:, cut:])):
                        g = hashes(part)
                        slot = np.where(_block_of(g, bits) == number, sent.value.found(g, part), -1)
                        for r, s in zip(rows[slot >= 0].tolist(), slot[slot >= 0].tolist(), strict=True):
                            parts[r][2 * (cut - 1) + side] = int(sent.value.counts[s])
            yield b.set_column(4, b.schema.field(4), pa.array(parts, b.schema.field(4).type))

    return found.mapInArrow(read, PHRASES)


def scored(found: DataFrame, totals: DataFrame, factor: int) -> DataFrame:
    """``found`` with l, r and score of the cut that counts; whole numbers of any length are exact here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "k", "words", "a", "parts", "n"]
        for b in batches:
            best = []
            for a, parts, n in rows_of([b], "a", "parts", "n"):
                cuts = [(factor * a * n // (parts[i] * parts[i + 1]), i) for i in range(0, len(parts), 2)]
                score, i = min(cuts)
                best.append((parts[i], parts[i + 1], score))
            columns = zip(*best, strict=True) if best else [[], [], []]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), *(pa.array(list(c), pa.int64()) for c in columns)], names=[*names, "l", "r", "score"])

    return found.join(totals, "lang").select("lang", "k", "words", "a", "parts", "n").mapInArrow(run, PHRASES + ", n long, l long, r long, score long")


def maximal(found: DataFrame) -> DataFrame:
    """Without phrases that lie in a longer one as often. One word more is enough to look at: if a phrase is as frequent as one with two words more, it
    is as frequent as one between."""
    shorter = found.filter("k > 2").select(
        F.explode(F.array(F.when(F.element_at("parts", F.col("k") * 2 - 3) == F.col("a"), F.slice("words", 1, F.col("k") - 1)), F.when(F.get("parts", F.lit(1)) == F.col("a"), F.slice("words", 2, F.col("k") - 1)))).alias("words")
    )
    return found.join(shorter.filter("words is not null").distinct(), "words", "left_anti")


def _mined(docs: DataFrame, seed: int, least: int, top: int, factor: int, block_size: int) -> DataFrame:
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // (6 * SHARE)).bit_length()))  # six bytes a word
    table = encoded(docs, seed, bits, least)
    found, filters = candidates(table, bits, least, block_size)
    listed = words_of(table, found, bits)
    if _alike(listed, "code") or _alike(found, "g"):
        raise Collision
    made, block_bits = blocks(found, block_size)
    text = table.select("lang", "values", "codes")
    kept: DataFrame | None = None
    numbers = sorted(r.block for r in made.select("block").collect())

    def block(number: int) -> Block:
        return pickle.loads(made.filter(F.col("block") == number).first().made)

    one = len(numbers) == 1
    if not numbers:
        return spark.createDataFrame([], OUT)
    with_counts: dict[int, Block | DataFrame] = {}  # of several blocks, only the one at hand is held
    for number in numbers:
        b = block(number)
        b.counts = counted(text, b, number, block_bits, filters, np.uint64(64 - bits))
        with_counts[number] = b if one else written(spark.createDataFrame([(pickle.dumps(b),)], "made binary"), "counts")
        more = frequent(spark, b, least)
        kept = written(more if kept is None else kept.unionByName(more), "frequent")  # as of each Python function in a stage a worker remains
    for number in numbers:
        b = with_counts[number]
        kept = written(with_parts(kept, b if isinstance(b, Block) else pickle.loads(b.first().made), number, block_bits), "parts")
    totals = table.groupBy("lang").agg(F.sum("n").alias("n"))
    final = maximal(written(scored(kept, totals, factor), "scored"))
    order = [F.desc("score"), F.desc("a")]
    near = final.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= top)
    near = near.select("lang", "words", "a", "l", "r", "n", "score", F.posexplode("words").alias("at", "code"))
    named = near.join(listed.select("code", "word"), "code").groupBy("lang", "words", "a", "l", "r", "n", "score").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("parts"))
    named = named.withColumn("phrase", F.array_join(F.transform("parts", lambda p: p["word"]), " "))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OUT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, factor: int = FACTOR, block_size: int = BLOCK, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases.

    Null texts are empty; a null language is ``und``; repeated rows count each; a word of any length is a word; ties are broken by the phrase's bytes;
    other columns are ignored; an empty table gives no rows.
    """
    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty(text_col).alias("text"))
    for seed in itertools.count():
        try:
            return _mined(slim, seed, least, top, factor, block_size)
        except Collision:
            continue


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP12_SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), listed as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from pieces
), totals as (
    select lang, sum(len(words))::hugeint as n from listed group by lang
), grams as (
    select lang, k, words[i:i + k - 1] as words, count(*) as f
    from (select lang, words, k, unnest(range(1, len(words) - k + 2)) as i from listed, range(1, 6) t(k)) group by lang, k, 3 having count(*) >= 100
), cuts as (
    select g.lang, g.words, g.k, g.f as a, c as cut, l.f as l, r.f as r, t.n, 1000::hugeint * g.f * t.n // (l.f::hugeint * r.f) as score
    from grams g join totals t using (lang), range(1, 5) u(c), grams l, grams r
    where c < g.k and l.lang = g.lang and l.words = g.words[1:c] and r.lang = g.lang and r.words = g.words[c + 1:]
), best as (
    select * from cuts qualify row_number() over (partition by lang, words order by score, cut) = 1
), within as (
    select distinct g.lang, g.words[i:i + j - 1] as words, max(g.f) as most
    from grams g, range(2, 5) t(j), range(1, 5) u(i) where j < g.k and i + j - 1 <= g.k group by all
), kept as (
    select b.* from best b left join within w on w.lang = b.lang and w.words = b.words where w.most is null or 100 * w.most < 100 * b.a
), named as (
    select lang, array_to_string(words, ' ') as phrase, a, l, r, n, score from kept
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from named qualify rank <= 2000
"""

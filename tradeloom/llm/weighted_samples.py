"""Document fingerprints by consistent weighted sampling (Ioffe, 2010).

A document's terms are its words, weighted by their counts. For each of the samples every term has, from its hash alone, r and c (gamma, shape 2)
and b (uniform). A term of weight w is sampled at t = floor(ln w / r + b) with ln a = ln c - r (t - b) - r; the term of the least a, with its t, is
the document's sample. Two documents have the same sample with a chance that is their generalised Jaccard similarity: the sum of the lesser
weights over the sum of the greater ones. 16 bits of each sample are kept, so unlike samples agree by a chance of 2^-16 more.

The edited texts need every document's neighbour in the order of ids. Ids (no texts) give quantiles; rows go to ranges between them, each read in
descending order by one task, which so knows the next document before it meets a row. The first document of a range goes to the range before it,
too. A range that holds one id only, however often, is split.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.common import arrow_batches, documents, rows_of, text_or_empty

SAMPLES = 128
#: Rows of a range (about).
RANGE_ROWS = 20_000
#: Terms whose draws a worker remembers (eight bytes a sample each), and terms drawn, or compared, at a time.
REMEMBERED, AT_ONCE = 1 << 16, 128
GOLDEN, MIX, MIX_MORE = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB  # SplitMix64
LEAST_ID = -(1 << 63)

DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def draws(hashes: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """For each term (a row) and sample (a column) a number whose order is that of a and whose low 16 bits are those of (term, t)."""
    z = hashes[:, None] + _steps(samples)
    z ^= z >> np.uint64(30)
    z *= np.uint64(MIX)
    z ^= z >> np.uint64(27)
    z *= np.uint64(MIX_MORE)
    z ^= z >> np.uint64(31)
    # 32 and 32 bits of one number give r; 24 and 24 of another c, and its other 16 b
    one, two = z[:, :samples], z[:, samples:]
    r = _gamma(one >> np.uint64(32), one & np.uint64(0xFFFFFFFF), 32)
    ln_c = np.log(_gamma(two >> np.uint64(40), (two >> np.uint64(16)) & np.uint64(0xFFFFFF), 24))
    b = ((two & np.uint64(0xFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-16)
    t = np.floor(np.log(weights)[:, None] / r + b)
    ln_a = ln_c - r * (t - b + np.float32(1))
    bits = ln_a.view(np.int32)
    bits = (bits ^ ((bits >> np.int32(31)) & np.int32(0x7FFFFFFF))).astype(np.int64)  # as whole numbers in the order of the real ones
    code = (one + t.astype(np.int64).view(np.uint64) * np.uint64(GOLDEN)) & np.uint64(0xFFFF)
    return (bits << np.int64(16)) | code.view(np.int64)


def _gamma(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """A draw of a gamma distribution of shape 2, the sum of two exponential ones, from two whole numbers of so many bits."""
    scale = np.float32(2.0**-bits)
    product = (x.astype(np.float32) + np.float32(0.5)) * scale
    product *= (y.astype(np.float32) + np.float32(0.5)) * scale
    np.minimum(product, np.float32(1 - 2.0**-24), out=product)
    return -np.log(product)


@lru_cache
def _steps(samples: int) -> np.ndarray:
    return (np.arange(1, 2 * samples + 1, dtype=np.uint64) * np.uint64(GOLDEN))[None, :]


class Sampler:
    """Fingerprints; the draws of terms met before are remembered."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self.table = np.empty((REMEMBERED, samples), dtype=np.int64)
        self.places: dict[tuple[bytes, int], int] = {}

    def fingerprint(self, text: str) -> np.ndarray:
        """16 bits for each sample; all zero for a text without words."""
        terms = list(Counter(text.encode().split()).items())
        if not terms:
            return np.zeros(self.samples, dtype=np.uint16)
        places = list(map(self.places.get, terms))
        known = np.fromiter((p for p in places if p is not None), dtype=np.int64)
        best = np.full(self.samples, np.iinfo(np.int64).max)
        for i in range(0, len(known), AT_ONCE):
            np.minimum(best, self.table[known[i : i + AT_ONCE]].min(axis=0), out=best)
        new = [term for term, p in zip(terms, places, strict=True) if p is None]
        for i in range(0, len(new), AT_ONCE):
            np.minimum(best, self._drawn(new[i : i + AT_ONCE]).min(axis=0), out=best)
        return (best & 0xFFFF).astype(np.uint16)

    def _drawn(self, terms: list[tuple[bytes, int]]) -> np.ndarray:
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(word) for word, _ in terms), dtype=np.uint64, count=len(terms))
        rows = draws(hashes, np.fromiter((n for _, n in terms), dtype=np.float32, count=len(terms)), self.samples)
        if len(self.places) + len(terms) > REMEMBERED:
            self.places.clear()
        first = len(self.places)
        self.table[first : first + len(terms)] = rows
        self.places.update(zip(terms, range(first, first + len(terms)), strict=True))
        return rows


def written_out(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u2").tobytes().hex()


def likeness(one: Column, other: Column) -> Column:
    """The share of equal samples of two fingerprints, written out in as many samples each."""
    starts = F.sequence(F.lit(1), F.length(one) - 3, F.lit(4))
    return F.size(F.filter(starts, lambda i: F.substr(one, i, F.lit(4)) == F.substr(other, i, F.lit(4)))) / F.size(starts)


def fingerprints(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (four hex digits a sample) of every whole text. Null and empty texts, and those of white space, have zeros; equal texts
    have equal fingerprints; a text without spaces is one term; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        rows = ((d, written_out(sampler.fingerprint(t))) for d, t in rows_of(batches, "doc_id", "text"))
        yield from arrow_batches(rows, pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())]))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def ranges(keys: DataFrame, parts: int) -> list[int]:
    """Upper ends (inclusive) of all ranges of ``key`` but the last, with about equally many rows in each. A key that is several quantiles has a
    range of its own."""
    shares = [i / parts for i in range(1, parts)]
    if not shares:
        return []
    found = keys.agg(F.percentile_approx("key", shares, max(10_000, 20 * parts))).first()[0] or []
    own = {a for a, b in zip(found, found[1:], strict=False) if a == b}
    return sorted({*found, *(k - 1 for k in own if k > LEAST_ID)})


def range_of(key: Column, ends: list[int]) -> Column:
    """The number of ends that are smaller, looked up in two steps."""
    if not ends:
        return F.lit(0)
    size = max(1, round(len(ends) ** 0.5))
    groups = [ends[i : i + size] for i in range(0, len(ends), size)]
    at = F.size(F.filter(F.lit([g[-1] for g in groups]), lambda x: x < key))
    within = F.get(F.lit([*groups, []]), at)
    return at * size + F.size(F.filter(within, lambda x: x < key)) - F.when(at == len(groups), len(groups) * size - len(ends)).otherwise(0)


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, text and lead, dealt out by ranges of ids (a null id is the least) and sorted in descending order, as ``edited`` reads them: the
    first row of a partition, of lead true, is the document after its last one."""
    spark = docs.sparkSession
    own = F.col(id_col).cast("long")
    rows = docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(LEAST_ID)).alias("key"), text_or_empty(text_col).alias("text"))
    total = rows.count()
    ends = ranges(rows.select("key"), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_rows)))
    ranged = rows.withColumn("range", range_of(F.col("key"), ends))
    counts = {r["range"]: r for r in ranged.groupBy("range").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("n")).collect()}  # one row a range
    if not counts:
        return rows.withColumn("lead", F.lit(False))
    used = sorted(counts)
    # ranges of a single id are dealt out to several partitions
    pieces = [-(-counts[r]["n"] // range_rows) if r in counts and counts[r]["least"] == counts[r]["most"] else 1 for r in range(len(ends) + 1)]
    first = [sum(pieces[:r]) for r in range(len(pieces))]
    dealt = ranged.withColumn("to", F.get(F.lit(first), F.col("range")) + F.pmod(F.monotonically_increasing_id(), F.get(F.lit(pieces), F.col("range"))))
    leads = [(counts[after]["least"], first[r] + i) for r, after in zip(used, [*used[1:], used[0]], strict=True) for i in range(pieces[r])]
    heads = rows.filter(F.col("key").isin(sorted({k for k, _ in leads}))).groupBy("key").agg(F.min("text").alias("text"))
    heads = heads.join(F.broadcast(spark.createDataFrame(leads, "key long, to long")), "key").withColumns({"lead": F.lit(True), "doc_id": F.lit(None).cast("long")})
    both = dealt.withColumn("lead", F.lit(False)).select("doc_id", "key", "text", "lead", "to").unionByName(heads)
    return both.repartitionById(sum(pieces), F.col("to").cast("int")).sortWithinPartitions(F.desc("lead"), F.desc("key"), F.desc("text")).drop("to")


def edited(docs: DataFrame, samples: int = SAMPLES, range_rows: int = RANGE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row its fingerprint, its edited text's, and how like they and the next document's are.

    The next document has the smallest greater id; of its rows the least text counts. After the greatest id comes the smallest (with one id only, that
    id itself). Rows repeated under one id have the same next document. A null text is empty; an empty text's edit is empty. A null id comes first.
    Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)

        def rows() -> Iterator[tuple]:
            after = last = (b"", "", None)  # key, text and fingerprint
            for doc_id, key, text, lead in rows_of(batches, "doc_id", "key", "text", "lead"):
                own = sampler.fingerprint(text)
                if lead or key != last[0]:
                    after = (key, text, own) if lead else last if last[0] != b"" else after
                if lead:
                    continue
                last = (key, text, own)
                cut = len(text) // 4
                changed = text[: len(text) - cut] + after[1][:cut]
                other = sampler.fingerprint(changed)
                yield doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), written_out(own), written_out(other), float(np.mean(own == other)), float(np.mean(own == after[2]))

        yield from arrow_batches(rows(), _SCHEMA, lambda row: 8 * samples + 128)

    return with_next(docs, range_rows, id_col, text_col).mapInArrow(run, DDL)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(documents(spark, sf_dir))

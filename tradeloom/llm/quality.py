"""Quality classifier by supervised subword embeddings.

A document is the mean of vectors of its words, pairs of words and character n-grams (3 and 4) of its words, all hashed to
``BUCKETS``; a softmax over two classes follows. Vectors and output weights are learned together by stochastic gradient
descent in numpy, on the driver, over a bounded sample. A score is then one number for each bucket, averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.common import arrow_batches, documents, held_out, rows_of, text_or_empty, written

BUCKETS = 1 << 16
DIMENSIONS = 8
#: Bounds of the training sample: rows, picked by a hash of id and text, and features of all its rows (of eight bytes each, 160 MB). Rows are taken in
#: the order of their hash until a bound is met; none is cut.
SAMPLE = 5000
MOST_FEATURES = 20_000_000
ROUNDS = 6
CHUNK = 1 << 20

_SPREAD = np.random.default_rng(11).integers(1, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)


def hashed(text: str) -> Iterator[np.ndarray]:
    """Buckets of all words, pairs of words next to one another, and 3- and 4-grams, ``CHUNK`` characters of the text at a time. What a cut
    parts is carried on: the open word's sum and length, the last whole word, and the last three characters."""
    gap_code, nothing = np.uint64(7), np.zeros(0, dtype=np.uint64)
    open_sum, open_length = np.zeros(1, dtype=np.uint64), 0
    last_word = nothing  # the word before the open one, if there is one
    tail, tail_blank = np.array([gap_code]), np.array([True])
    for i in range(0, len(text) + 1, CHUNK):
        end = int(i + CHUNK > len(text))  # a gap ends the text
        codes = np.frombuffer(text[i : i + CHUNK].encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        gap = np.concatenate([(codes == 32) | ((codes >= 9) & (codes <= 13)), np.ones(end, dtype=bool)])
        c = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        c = np.where(gap, np.uint64(0), np.concatenate([c ^ (c >> np.uint64(32)), np.zeros(end, dtype=np.uint64)]))

        at = np.arange(len(c))
        after = np.maximum.accumulate(np.where(gap, at + 1, 0)) if len(c) else at  # where the word of a character starts
        place = at - after + np.where(after == 0, open_length, 0)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(c * _SPREAD[place % 64])])
        ends = np.flatnonzero(gap & np.concatenate([[open_length > 0], ~gap[:-1]])[: len(gap)])
        begins = after[np.maximum(ends - 1, 0)]
        begins = np.where(ends == 0, 0, begins)
        words = sums[ends] - sums[begins] + np.where(begins == 0, open_sum, np.uint64(0))
        if len(gap) and gap[-1]:
            open_sum, open_length = np.zeros(1, dtype=np.uint64), 0
        elif len(gap):
            first = int(after[-1])
            carried = (open_sum, open_length) if first == 0 else (np.zeros(1, dtype=np.uint64), 0)
            open_sum, open_length = sums[-1:] - sums[first : first + 1] + carried[0], len(c) - first + carried[1]
        yield _mixed(words)
        row = np.concatenate([last_word, words])
        yield _mixed((row[1:] ^ row[:-1]) + np.uint64(11))  # a word and itself are one bucket, whatever the word
        last_word = row[-1:]

        known = len(tail)
        edged, blank = np.concatenate([tail, np.where(gap, gap_code, c)]), np.concatenate([tail_blank, gap])
        three = edged[:-2] * _SPREAD[1] + edged[1:-1] * _SPREAD[2] + edged[2:] * _SPREAD[3]
        fresh = max(0, known - 2)
        yield _mixed(three[fresh:][~blank[1:-1][fresh:]])
        if len(edged) > 3:
            four = three[:-1] * _SPREAD[4] + edged[3:] * _SPREAD[5]
            fresh = max(0, known - 3)
            yield _mixed(four[fresh:][~(blank[1:-2] | blank[2:-1])[fresh:]])
        tail, tail_blank = edged[-3:], blank[-3:]


class QualityModel:
    """bucket_scores: the difference of both classes' outputs for each bucket; bias likewise."""

    def __init__(self, bucket_scores: np.ndarray, bias: float):
        self.bucket_scores, self.bias = bucket_scores, bias

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for h in hashed(text or ""):
            total += float(self.bucket_scores[h].sum(dtype=np.float64))
            n += len(h)
        z = (total / n if n else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(docs: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = ROUNDS, rate: float = 0.5, seed: int = 5) -> QualityModel:
    """docs: buckets (each once), their shares and the label. One document a step; the rate falls linearly."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output, bias = np.zeros((2, DIMENSIONS), dtype=np.float32), np.zeros(2, dtype=np.float32)
    steps, done = max(1, rounds * len(docs)), 0
    for _ in range(rounds):
        for i in rng.permutation(len(docs)):
            buckets, shares, label = docs[i]
            step = np.float32(rate * (1 - done / steps))
            done += 1
            mean = shares @ vectors[buckets]
            z = output @ mean + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[label] -= 1
            back = error @ output
            output -= step * np.outer(error, mean)
            bias -= step * np.float32(0.1) * error
            vectors[buckets] -= (step * np.float32(20) * shares)[:, None] * back  # shares are small; a larger rate for vectors
    return QualityModel((vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text, each once, with their shares."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for h in hashed(text):
        counts += np.bincount(h.astype(np.int64), minlength=BUCKETS)
    buckets = np.flatnonzero(counts)
    return buckets.astype(np.int32), (counts[buckets] / max(1, counts.sum())).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, most_features: int = MOST_FEATURES) -> QualityModel:
    """Learns from ``sample`` labelled documents at most, with ``most_features`` in all, picked by a hash of id and text; of several labels the mean is
    rounded. Equal rows count once, however often one is repeated.

    Null ids, labels and texts are not used. Without labels all scores are one half; with one class they follow it.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("mark")).dropna().groupBy("doc_id").agg((F.avg("mark") >= 0.5).cast("int").alias("mark"))
    # the first ids by their hash, and of their rows again the first ones
    picked = marked.withColumn("p", F.xxhash64("doc_id")).orderBy("p", "doc_id").limit(sample).drop("p")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).dropna()
    rows = texts.join(F.broadcast(picked), "doc_id").withColumn("h", F.xxhash64("doc_id", "text"))  # ids of the sample: bounded by its size
    first = rows.select("h").distinct().orderBy(F.xxhash64("h"), "h").limit(sample)
    chosen = rows.join(F.broadcast(first), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("mark", pa.int32()), ("n", pa.int32()), ("buckets", pa.binary()), ("shares", pa.binary())])
        seen: set[int] = set()  # of the sample's rows

        def fresh(rows: Iterator[tuple]) -> Iterator[tuple]:
            for h, t, m in rows:
                if h not in seen:
                    seen.add(h)
                    buckets, shares = bag(t)
                    yield h, m, len(buckets), buckets.tobytes(), shares.tobytes()

        yield from arrow_batches(fresh(rows_of(batches, "h", "text", "mark")), schema, lambda r: len(r[3]) * 2 + 64)

    bags = written(chosen.mapInArrow(run, "h long, mark int, n int, buckets binary, shares binary").distinct(), "bags")
    within, total = [], 0
    for h, n in sorted({(r["h"], r["n"]) for r in bags.select("h", "n").collect()}):  # two numbers a row of the sample
        total += n
        if total > most_features:
            break
        within.append(h)
    most = within[-1] if within else 0
    found = bags.filter((F.col("h") <= most) & (F.col("n") > 0)).collect() if within else []  # a bounded sample
    found.sort(key=lambda r: (r["h"], r["buckets"]))
    return train([(np.frombuffer(r["buckets"], dtype=np.int32), np.frombuffer(r["shares"], dtype=np.float32), r["mark"]) for r in found])


def scored(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text. Null and empty texts get the score of no features; other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for (t,) in rows_of([b], "text")], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = documents(spark, sf_dir, "labels").filter(~held_out("doc_id", 3, 1))
    found = scored(docs, fit(docs, labels))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Language identification in two steps: the family first, then the language within it.

Features are counts of letter n-grams (1 to 3) hashed to ``BUCKETS``, as square roots at unit length. Families, and the
languages within a family, are told apart by linear support vector machines, one for each pair, trained in numpy on the
driver by dual coordinate descent over a bounded sample; votes decide, margins break ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeloom.llm.common import arrow_batches, documents, held_out, rows_of

BUCKETS = 4096
#: Bounds of the training sample: rows of one language and of all (fewer of each where there are many languages), and languages, those with most
#: rows: each pair of their families has a machine of 16 KB.
SAMPLE_PER_LANGUAGE = 600
SAMPLE = 6000
LANGUAGES = 64
CHUNK = 1 << 20
UNDETERMINED = "und"

#: Families of languages by ISO 639-1 code (fixed values). A language not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt uz",
    "celtic": "br cy ga gd",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
    "austronesian": "id jv mg ms tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], lang)


_LETTER: list[np.ndarray] = []


def _letters(codes: np.ndarray) -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0][codes]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def features(text: str) -> np.ndarray:
    """Hashed n-gram counts of the whole text, as square roots at unit length. A run of other characters than letters is one gap; a gap
    also leads and ends the text. ``CHUNK`` characters are handled at once, with the two before them for n-grams over the cut."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    low = text.lower()
    before = np.zeros(1, dtype=np.uint32)  # up to two codes that were counted already
    for i in range(0, len(low) + 1, CHUNK):
        codes = np.frombuffer(low[i : i + CHUNK].encode("utf-32-le"), dtype=np.uint32)
        codes = np.concatenate([before, np.where(_letters(codes), codes, 0).astype(np.uint32), np.zeros(int(i + CHUNK > len(low)), dtype=np.uint32)])
        codes = codes[np.concatenate([np.ones(len(before), dtype=bool), (codes[len(before) :] != 0) | (codes[len(before) - 1 : -1] != 0)])]
        one = codes * np.uint32(2654435761)
        two = (one[:-1] ^ (one[:-1] >> 15)) * np.uint32(2246822519) + one[1:]
        three = (two[:-1] ^ (two[:-1] >> 13)) * np.uint32(3266489917) + one[2:]
        known = len(before)
        for h in (one[known:][codes[known:] != 0], two[known - 1 :], three[max(0, known - 2) :]):
            counts += np.bincount((h ^ (h >> 16)) % BUCKETS, minlength=BUCKETS)
        before = codes[-2:]
    x = np.sqrt(counts).astype(np.float32)
    norm = float(np.sqrt(counts.sum()))
    return x / norm if norm else x


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 8.0, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by dual coordinate descent; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    w, alpha, slack = np.zeros(x.shape[1], dtype=np.float32), np.zeros(len(x)), 1 / (2 * cost)
    own = (x * x).sum(axis=1) + slack
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            step = max(alpha[i] - (y[i] * float(w @ x[i]) - 1 + slack * alpha[i]) / own[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += np.float32(step * y[i]) * x[i]
    return w


class PairwiseMachine:
    """One machine for each pair of classes."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.classes = sorted(set(labels))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        at, weights = np.array([self.classes.index(v) for v in labels]), []
        for a, b in self.pairs:
            rows = np.flatnonzero((at == a) | (at == b))
            weights.append(train_svm(x[rows], np.where(at[rows] == a, 1.0, -1.0)))
        self.weights = np.array(weights, dtype=np.float32).reshape(len(self.pairs), BUCKETS + 1)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The class with most votes, ties by the sum of margins; its mean probability against the others."""
        if not self.pairs:
            return self.classes[0], 1.0
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        chance = 1 / (1 + np.exp(-4 * np.clip(margins, -8, 8).astype(np.float64)))
        votes, total, sure = (np.zeros(len(self.classes)) for _ in range(3))
        for (a, b), m, p in zip(self.pairs, margins, chance, strict=True):
            votes[a if m >= 0 else b] += 1
            total[a], total[b] = total[a] + m, total[b] - m
            sure[a], sure[b] = sure[a] + p, sure[b] + 1 - p
        best = max(range(len(self.classes)), key=lambda c: (votes[c], total[c], -c))
        return self.classes[best], float(sure[best] / (len(self.classes) - 1))


class LanguageModel:
    def __init__(self, x: np.ndarray, langs: list[str]):
        self.families = PairwiseMachine(x, [family_of(v) for v in langs]) if langs else None
        self.within = {}
        for family in self.families.classes if self.families else []:
            rows = [i for i, v in enumerate(langs) if family_of(v) == family]
            self.within[family] = PairwiseMachine(x[rows], [langs[i] for i in rows])

    def predict(self, text: str | None) -> tuple[str, float]:
        if self.families is None or not has_letter(text):
            return UNDETERMINED, 0.0
        x = features(text)
        family, p = self.families.predict(x)
        lang, q = self.within[family].predict(x)
        return lang, p * q


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, total: int = SAMPLE, languages: int = LANGUAGES) -> LanguageModel:
    """Learns from ``per_language`` rows at most of each of the ``languages`` with most rows (``total`` in all), picked by a hash of id and text.

    Rows with a null id, text or language are not used; equal rows count once, however often one is repeated. Only hashed counts of the sample reach the
    driver.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna().withColumn("h", F.xxhash64("doc_id", "text"))
    distinct = rows.select("lang", "h").distinct().groupBy("lang").count()
    counts = {r["lang"]: r["count"] for r in distinct.orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return LanguageModel(np.zeros((0, BUCKETS), dtype=np.float32), [])
    share = min(per_language, max(1, total // len(counts)))
    # about a quarter more than are wanted, of which the first ones by their hash stay
    keep = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, int(min(1.0, (1.25 * share + 20) / n) * (1 << 30)))])
    sample = rows.filter(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < keep[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("x", pa.binary())])
        last: set[tuple[int, str]] = set()

        def fresh(rows: Iterator[tuple]) -> Iterator[tuple]:
            for h, text, lang in rows:
                if (h, lang) not in last and has_letter(text):
                    last.add((h, lang))
                    yield h, lang, features(text).astype(np.float16).tobytes()
                if len(last) > total:
                    last.clear()

        yield from arrow_batches(fresh(rows_of(batches, "h", "text", "lang")), schema, lambda r: 2 * BUCKETS)

    made = sample.mapInArrow(run, "h long, lang string, x binary").distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("h"), "h", "x"))
    found = sorted(made.withColumn("place", first).filter(F.col("place") <= share).collect(), key=lambda r: (r["h"], r["lang"], r["x"]))  # a bounded sample
    x = np.array([np.frombuffer(r["x"], dtype=np.float16) for r in found], dtype=np.float32).reshape(len(found), BUCKETS)
    return LanguageModel(x, [r["lang"] for r in found])


def predicted(docs: DataFrame, model: LanguageModel, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two more columns, called ``names``: the language and its score (0 to 1). Null texts and texts without a letter are ``und`` with score 0; a text
    of any length is read whole; repeated rows get equal values."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            found = [model.predict(t) for (t,) in rows_of([b], text_col)]
            b = b.append_column(names[0], pa.array([f[0] for f in found], pa.string()))
            yield b.append_column(names[1], pa.array([f[1] for f in found], pa.float64()))

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: a language is given and crc32 of the id leaves no 2 modulo 4."""
    return docs.filter(F.col("lang").isNotNull() & ~held_out("doc_id", 4, 2))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predicted(docs.select("doc_id", "text"), fit(training_rows(docs)))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")

"""A corpus pipeline of five stages: language, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm import exact_dedup, language_id, packing, secrets, simhash
from tradeloom.llm.common import documents, removed, scratch, stored, text_or_empty
from tradeloom.shipping import ship

#: A prediction with less certainty is rejected, as is a text without letters. The score is a product of two mean chances: with two
#: families of two languages it is 0.25 at least, whatever the text; of 1500 held-out documents of sf0.1 the least has 0.53, of 300 texts
#: of random letters nine in ten have less than 0.43.
LEAST_LANGUAGE_SCORE = 0.45
#: Near copies share a similarity of 0.8 or more in shingles of five words.
NEAR = simhash.similar(0.8, size=5)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language is uncertain. Learns from ``docs`` itself."""
    model = language_id.fit(language_id.training_rows(docs))
    found = language_id.predicted(docs, model, names=("__lang", "__score"))
    return found.filter((F.col("__lang") != language_id.UNDETERMINED) & (F.col("__score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return exact_dedup.kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near copies."""
    own_id, own_hash = F.col("doc_id").cast("long"), F.when(F.col("doc_id").isNull(), F.xxhash64(text_or_empty("text")))
    kept = simhash.near_classes(docs, NEAR).filter("kept").select(F.col("doc_id").alias("__id"), F.when(F.col("doc_id").isNull(), F.col("text_hash")).alias("__hash")).distinct()
    return docs.join(kept, own_id.eqNullSafe(kept["__id"]) & own_hash.eqNullSafe(kept["__hash"]), "left_semi")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; every document stays."""
    out = secrets.redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts' tokens into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("exact copies", exact_copies),
    ("near copies", near_copies),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL can't express trained models, tokenizers and the search of near copies.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each returns is written to the shared folder and read again. What a stage wrote besides is deleted after it, its
    input, too, unless it is a given table."""
    ship(spark)
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs, path = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        removed(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)

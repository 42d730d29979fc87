"""Nested JSON stores of classifications moved into one table, by key, so that moving them again changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.text import history_key
from tradeloom.operators.common import winners

ASSESSED = "map<string, struct<code: string, category: string, sample_desc: string, confidence: double, count: long, total: long, sources: array<string>, inventory_refs: array<string>>>"
CACHE = "map<string, struct<original_description: string, code: string, category: string, source: string, confidence: double, notes: string, verified_against_assessed: boolean>>"
#: Keys of a store that are no descriptions (fixed values).
METADATA, TAX_PREFIX, ASSESSED_SOURCE = "_metadata", "__asycuda_", "assessed_exact"
COLUMNS = ["description", "description_norm", "tariff_code", "category", "source", "confidence", "notes", "unverified", "assessed_count", "assessed_total", "assessed_sources", "inventory_refs", "is_active"]


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def assessed_rows(stores: DataFrame, json: str = "json") -> DataFrame:
    """Rows of stores (one JSON document a row) of assessed codes by description: ``entries``, or the document itself."""
    nested = F.from_json(F.get_json_object(json, "$.entries"), ASSESSED)
    entries = F.when(F.get_json_object(json, "$.entries").isNotNull(), nested).otherwise(F.from_json(json, ASSESSED))
    e = F.col("e")
    return stores.select(F.explode(entries).alias("key", "e")).filter(F.col("key") != METADATA).select(
        F.coalesce(e["sample_desc"], "key").alias("description"), F.col("key").alias("description_norm"), e["code"].alias("tariff_code"), F.coalesce(e["category"], F.lit("")).alias("category"), F.lit(ASSESSED_SOURCE).alias("source"),
        F.coalesce(e["confidence"], F.lit(0.0)).alias("confidence"), F.concat(F.lit("count="), F.coalesce(e["count"], F.lit(0)), F.lit("/"), F.coalesce(e["total"], F.lit(0))).alias("notes"), F.lit(0).alias("unverified"), e["count"].alias("assessed_count"),
        e["total"].alias("assessed_total"), F.when(F.size(e["sources"]) > 0, F.to_json(e["sources"])).alias("assessed_sources"), F.when(F.size(e["inventory_refs"]) > 0, F.to_json(e["inventory_refs"])).alias("inventory_refs"), F.lit(1).alias("is_active"),
    ).filter(_filled(F.col("description_norm")) & _filled(F.col("tariff_code")))


def cache_rows(stores: DataFrame, assessed: DataFrame, json: str = "json") -> DataFrame:
    """Rows of stores of looked-up codes. Tax entries, entries without a description or code, and those whose heading (four digits) differs from that
    of an assessed code of the same description go."""
    e = F.col("e")
    rows = stores.select(F.explode(F.from_json(json, CACHE)).alias("key", "e")).filter(~F.col("key").startswith(TAX_PREFIX))
    rows = rows.withColumn("description", F.coalesce(e["original_description"], "key")).withColumn("description_norm", history_key(F.col("description")))
    rows = rows.filter(_filled(F.col("description_norm")) & _filled(e["code"]))
    headings = winners(assessed, ["description_norm"], F.desc("confidence"), F.desc("tariff_code")).select("description_norm", F.substring("tariff_code", 1, 4).alias("heading"))
    kept = rows.join(headings, "description_norm", "left").filter(F.col("heading").isNull() | (F.substring(e["code"], 1, 4) == F.col("heading")))
    none = F.lit(None)
    return kept.select(
        "description", "description_norm", e["code"].alias("tariff_code"), F.coalesce(e["category"], F.lit("")).alias("category"), F.coalesce(e["source"], F.lit("web_search")).alias("source"), F.coalesce(e["confidence"], F.lit(0.5)).alias("confidence"),
        F.coalesce(e["notes"], F.lit("")).alias("notes"), F.when(F.coalesce(e["verified_against_assessed"], F.lit(False)), 0).otherwise(1).alias("unverified"), none.cast("long").alias("assessed_count"), none.cast("long").alias("assessed_total"),
        none.cast("string").alias("assessed_sources"), none.cast("string").alias("inventory_refs"), F.lit(1).alias("is_active"),
    )


def migrated(classifications: DataFrame, assessed_stores: DataFrame, cache_stores: DataFrame) -> DataFrame:
    """``classifications`` with the rows of both kinds of stores that it doesn't have yet (by all columns), each once. Later steps see the assessed codes
    that are in the table already, too."""
    new = assessed_rows(assessed_stores)
    known = classifications.filter(F.col("source") == ASSESSED_SOURCE).filter("is_active = 1").select("description_norm", "tariff_code", "confidence")
    more = cache_rows(cache_stores, known.unionByName(new.select("description_norm", "tariff_code", "confidence")))
    rows = new.unionByName(more).distinct()
    own = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in COLUMNS]
    fresh = rows.alias("n").join(classifications.select(*COLUMNS).alias("o"), own, "left_anti")
    return classifications.select(*COLUMNS).unionByName(fresh)


def lookup(classifications: DataFrame) -> DataFrame:
    """The most certain active classification of each description."""
    active = classifications.filter("is_active = 1")
    return winners(active, ["description_norm"], F.desc("confidence"), F.desc("tariff_code"), F.desc("source"), F.desc("description")).select("description_norm", "tariff_code", "category", "confidence", "source", F.col("description").alias("sample_desc"), "notes")

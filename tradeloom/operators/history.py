"""Sets, upserts and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.operators.common import winners


def superseded(events: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """History of a value by key: one row for each run of equal values, with its highest confidence, whether it is active, and the
    order of the run that superseded it (null for the active one)."""
    w = Window.partitionBy(key).orderBy(order)
    fresh = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    runs = events.withColumn("__new", fresh).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(key, "run", value).agg(F.min(order).alias("since"), F.max("confidence").alias("confidence"), F.count("*").alias("times"))
    after = F.lead("since").over(Window.partitionBy(key).orderBy("run"))
    return merged.withColumn("superseded_by", after).withColumn("is_active", F.col("superseded_by").isNull()).drop("run")


def changes(events: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``events`` that change a key's value, with the value before; a key's first event changes nothing."""
    w = Window.partitionBy(key).orderBy(order)
    return events.withColumn("old", F.lag(value).over(w)).filter(F.col("old").isNotNull() & (F.col("old") != F.col(value))).select(key, order, "old", F.col(value).alias("new"))


def upserted(old: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """``old`` with the rows of ``new``: the last new row of a key counts, its nulls keep what was there."""
    last = winners(new, [key], order)
    columns = [c for c in old.columns if c != key]
    renamed = last.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns])
    return old.join(renamed, key, "full_outer").select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in columns])


def filled_only(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with ``new`` values where a value was null or empty."""
    columns = [c for c in old.columns if c != key]
    joined = old.join(new.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns]), key, "left")
    return joined.select(key, *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}")).alias(c) for c in columns])


def codes_refreshed(codes: DataFrame, accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    return codes.select("code").union(accepted.select("code")).distinct().join(rejected.select("code").distinct(), "code", "left_anti")


def duplicate_pairs(rows: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """keys, first and others of rows that share all keys: each copy with the first, not all pairs."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(ident).alias("first")).filter("n > 1")
    return rows.join(groups, keys).filter(F.col(ident) != F.col("first")).select(*keys, "first", F.col(ident).alias("other"))


def stale(existing: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    return existing.join(expected.select(key), key, "left_anti")


def layouts_united(*layouts: DataFrame) -> DataFrame:
    """Tables of different layouts as one; a column that one lacks is null there."""
    out = layouts[0]
    for other in layouts[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def resend_due(history: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys whose parameters' hash is not the one last sent."""
    return history.join(current.select(key, F.col("params_hash").alias("__new")), key).filter(F.col("params_hash") != F.col("__new")).select(key)

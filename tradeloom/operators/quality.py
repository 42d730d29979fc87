"""Findings about items, invoices and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.codes import is_leaf
from tradeloom.functions.text import words


def findings(rows: DataFrame, checks: dict[str, Column], *keys: str) -> DataFrame:
    """keys and finding, a row for each check that is true (null is not)."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return rows.select(*keys, F.explode(found).alias("finding"))


def item_checks(placeholder: str = "UNKNOWN", payment: str = "(?i)payment|deposit|balance due", generic: tuple[str, ...] = ("item", "goods", "misc")) -> dict[str, Column]:
    """Checks of one item: columns sku, description, tariff_code, quantity, unit_cost, total_cost."""
    text = F.trim(F.coalesce("description", F.lit("")))
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return {
        "MISSING_TARIFF": F.col("tariff_code").isNull() | (F.col("tariff_code") == ""),
        "INVALID_TARIFF": (F.col("tariff_code") != "") & ~is_leaf(F.col("tariff_code")),
        "ZERO_VALUE": F.col("total_cost") == 0,
        "VARIANCE": F.abs(F.col("quantity") * F.col("unit_cost") - F.col("total_cost")) > 0.01,
        "PLACEHOLDER_SKU": F.upper("sku") == placeholder,
        "PAYMENT_LINE": text.rlike(payment),
        "LEADING_TARIFF": text.rlike(r"^\d{8}\b"),
        "GENERIC": F.lower(text).isin(*generic),
        "TOO_SHORT": F.length(text) < 3,
        "GARBAGE": (F.length(text) >= 3) & (letters * 3 < F.length(text)),
        "NO_QUANTITY": (F.col("quantity") == 0) & (F.col("total_cost") > 0),
        "NOT_POSITIVE": F.col("total_cost") < 0,
    }


def duplicates(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def conflicts(items: DataFrame, products: dict[str, list[str]], chapters: dict[str, list[str]]) -> DataFrame:
    """``items`` whose description names a product that its chapter does not allow: products: class to words; chapters: chapter to
    classes. Both must be known and disjoint."""
    own = F.array_distinct(words(F.lower("description")))
    named = F.array_compact(F.array(*[F.when(F.arrays_overlap(own, F.array(*map(F.lit, ws))), F.lit(k)) for k, ws in products.items()]))
    allowed = F.coalesce(*[F.when(F.substring("tariff_code", 1, 2) == c, F.array(*map(F.lit, ks))) for c, ks in chapters.items()])
    return items.withColumn("__named", named).withColumn("__allowed", allowed).filter((F.size("__named") > 0) & F.col("__allowed").isNotNull() & ~F.arrays_overlap("__named", "__allowed")).drop("__named", "__allowed")


def zero_items_dropped(items: DataFrame, totals: DataFrame) -> DataFrame:
    """Items of invoices with a total: those of no cost and price, or of no quantity, go. Invoices without a total keep all."""
    joined = items.join(totals.select("invoice_id", "invoice_total"), "invoice_id", "left")
    nothing = ((F.col("total_cost") == 0) & (F.col("unit_cost") == 0)) | (F.col("quantity") == 0)
    return joined.filter(~((F.coalesce("invoice_total", F.lit(0)) > 0) & nothing)).select(*items.columns)


def counts_compared(source: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """Keys whose number of rows differs."""
    a, b = source.groupBy(key).agg(F.count("*").alias("source_rows")), written.groupBy(key).agg(F.count("*").alias("written_rows"))
    out = a.join(b, key, "full_outer").fillna(0, ["source_rows", "written_rows"])
    return out.filter("source_rows <> written_rows")


def scan_score(text: Column) -> Column:
    """Points (0 to 100) for how well a page was read: length, prices, a total, a number, real lines, structure."""
    prices = F.regexp_count(text, F.lit(r"\d+\.\d{2}"))
    structure = F.regexp_count(F.lower(text), F.lit("invoice|total|date|quantity|description|price"))
    lines = F.regexp_count(text, F.lit(r"(?m)^\S+ \S+ \S+"))
    return (
        F.when(F.length(text) >= 500, 10).when(F.length(text) >= 100, 5).otherwise(0)
        + F.least(prices * 5, F.lit(25))
        + F.when(F.lower(text).rlike(r"total"), 20).otherwise(0)
        + F.when(F.lower(text).rlike(r"(invoice|order) *(no|number|#)"), 10).otherwise(0)
        + F.least(lines * 5, F.lit(25))
        + F.least(structure * 2, F.lit(10))
    )


def scan_grade(score: Column) -> Column:
    return F.when(score >= 70, "good").when(score >= 40, "fair").when(score >= 15, "poor").otherwise("unusable")

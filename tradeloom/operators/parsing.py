"""Rows out of text: fields of several lines, columns and tables; tests of lines and pages; rates of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions.money import currency, recognised
from tradeloom.operators.ordering import islands

PRICE = r"\d+\.\d{2}\b"


def cleaned(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Expressions replaced one after another, then trimmed."""
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def typed(value: Column, kind: str) -> Column:
    """A field of a declared type: currency, number, integer (recognised digits), date (kept as text) or text; null if it fails."""
    if kind == "currency":
        return currency(value)
    if kind == "number":
        return F.replace(F.trim(value), F.lit(","), F.lit("")).try_cast("double")
    if kind == "integer":
        return recognised(value).cast("int")
    return F.nullif(F.trim(value), F.lit(""))


def multiline_items(lines: DataFrame, group: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Items whose description runs over lines until one with a price closes it: group, item, description, price. What follows the last
    price is no item."""
    w = Window.partitionBy(group).orderBy(order)
    closes = F.col("line").rlike(PRICE)
    numbered = lines.withColumn("item", F.coalesce(F.sum(closes.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    price = F.max(F.when(closes, F.regexp_extract("line", rf"({PRICE})(?!.*{PRICE})", 1)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.trim(F.regexp_replace("line", rf"\$?{PRICE}", "")).alias("t")))), lambda s: s["t"]), " ")
    return numbered.groupBy(group, "item").agg(F.trim(F.regexp_replace(text, " +", " ")).alias("description"), price.cast("decimal(18,2)").alias("price")).filter("price is not null")


def column_items(descriptions: DataFrame, prices: DataFrame, group: str, order: str) -> DataFrame:
    """The i-th description of a document with its i-th price; what has no partner stays with a null."""
    w = Window.partitionBy(group).orderBy(order)
    a = descriptions.withColumn("n", F.row_number().over(w)).select(group, "n", "description")
    b = prices.withColumn("n", F.row_number().over(w)).select(group, "n", "price")
    return a.join(b, [group, "n"], "full_outer")


def table_rows(lines: DataFrame, ident: str, fields: list[str], delimiter: str = "\t") -> DataFrame:
    """Rows of a delimited dump; header rows (half of the cells and one more are field names) and summary rows go, as do short ones."""
    cells = F.transform(F.split("line", delimiter), lambda c: F.trim(c))
    named = F.size(F.filter("__c", lambda c: F.lower(c).isin([f.lower() for f in fields])))
    rows = lines.withColumn("__c", cells).filter((F.size("__c") >= len(fields)) & (named < len(fields) / 2 + 1) & ~F.get("__c", 0).rlike("(?i)^(sub)?total|^balance|^amount due"))
    return rows.select(ident, "line_no", *[F.get("__c", i).alias(f) for i, f in enumerate(fields)])


def sensible(line: Column) -> Column:
    """Whether a line reads like text: it has a price, or words of a likely length make up most of it."""
    parts = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    likely = F.size(F.filter(parts, lambda w: F.length(w).between(2, 15) & w.rlike("^[A-Za-z0-9.,'-]+$")))
    return line.rlike(PRICE) | ((F.size(parts) >= 2) & (likely * 2 > F.size(parts)))


def page_position(text: Column, header: str, footer: str) -> Column:
    """header, footer or body: by the number of different marks of each."""
    heads, feet = (F.size(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(p), F.lit(0)))) for p in (header, footer))
    return F.when((heads >= 1) & (heads >= feet), "header").when(feet >= 2, "footer").otherwise("body")


def page_marker(text: Column) -> Column:
    """The page number of the last ``page n of m`` near the end, if 1 <= n <= m <= 20."""
    tail = F.lower(F.substr(text, F.greatest(F.length(text) - 399, F.lit(1))))
    n, m = (F.element_at(F.regexp_extract_all(tail, F.lit(r"page (\d{1,4}) of (\d{1,4})"), F.lit(i)), -1).cast("int") for i in (1, 2))
    return F.when(F.size(F.regexp_extract_all(tail, F.lit(r"page (\d{1,4}) of (\d{1,4})"), F.lit(1))) > 0, F.when((n >= 1) & (n <= m) & (m <= 20), n))


def pages_ordered(pages: DataFrame, group: str, order: str, ident: str, marker: str) -> DataFrame:
    """``pages`` with island and place: runs of one identity, in the order of their page markers where all have different ones, else
    as they came."""
    found = islands(pages, group, order, ident)
    sums = found.groupBy(group, "island").agg(F.count(marker).alias("__known"), F.countDistinct(marker).alias("__different"), F.count("*").alias("__n"))
    joined = found.join(sums, [group, "island"])
    by = F.when((F.col("__known") == F.col("__n")) & (F.col("__different") == F.col("__n")), F.col(marker)).otherwise(F.lit(0))
    return joined.withColumn("__by", by).withColumn("place", F.row_number().over(Window.partitionBy(group, "island").orderBy("__by", order))).drop("__known", "__different", "__n", "__by")


def reading_confidence(lines: DataFrame) -> DataFrame:
    """doc_id and the share of line clusters on which all readings agree (3 decimals)."""
    each = lines.groupBy("doc_id", "cluster").agg((F.countDistinct(F.lower(F.trim("text"))) == 1).cast("int").alias("same"))
    return each.groupBy("doc_id").agg(F.round(F.avg("same").cast("decimal(18,8)"), 3).cast("double").alias("confidence"), F.count("*").alias("clusters"))


def packages_checked(rows: DataFrame) -> DataFrame:
    """shipment_id, packages, expected and agrees: the sum over invoices against the bill, else the manifest, else the number of invoices."""
    sums = rows.groupBy("shipment_id").agg(F.sum("packages").alias("packages"), F.coalesce(F.max("bill_packages"), F.max("manifest_packages"), F.count("*")).alias("expected"))
    return sums.withColumn("agrees", F.col("packages") == F.col("expected"))


def split_needed(groups: DataFrame, shipment: str, by: list[str]) -> DataFrame:
    """Shipments of more than one group, with the number of groups."""
    return groups.select(shipment, *by).distinct().groupBy(shipment).agg(F.count("*").alias("groups")).filter("groups > 1")


def outcome_rates(outcomes: DataFrame) -> DataFrame:
    """Counts and shares (4 decimals) of each outcome."""
    counts = outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy())  # a row for each outcome
    return counts.withColumn("share", F.round((F.col("n") / whole).cast("decimal(18,8)"), 4).cast("double"))


def anchored(items: DataFrame, again: DataFrame, subtotals: DataFrame, key: str = "invoice_id", near: str = "0.02") -> DataFrame:
    """``items`` and reread: where a ``key``'s sum of total_cost is off its printed subtotal by more than ``near``, the rows ``again`` of a more permissive
    reading (same columns) take their place, if those meet the subtotal.

    A permissive reading's quantities aren't to be trusted: each row with a unit_cost counts once. Missing amounts count as nothing; without a
    subtotal above zero, or without ``again`` rows, the items stay. A ``key`` without items can be filled by ``again``.
    """
    once = F.coalesce(F.col("unit_cost") > 0, F.lit(False))
    quantity = F.when(once, F.lit(1)).otherwise(F.col("quantity")).cast(again.schema["quantity"].dataType)
    total = F.when(once, F.round("unit_cost", 2)).otherwise(F.col("total_cost")).cast(items.schema["total_cost"].dataType)
    again = again.withColumns({"quantity": quantity, "total_cost": total})
    amount = F.sum(F.coalesce("total_cost", F.lit(0)))
    sums = subtotals.filter("subtotal > 0").join(items.groupBy(key).agg(amount.alias("__own")), key, "left").join(again.groupBy(key).agg(amount.alias("__again")), key)
    off = lambda c: F.abs(F.coalesce(c, F.lit(0)) - F.col("subtotal"))
    chosen = sums.filter((off("__own") > F.lit(near).cast("decimal(18,4)")) & (off("__again") <= F.lit(near).cast("decimal(18,4)"))).select(key).distinct()
    kept = items.join(chosen, key, "left_anti").withColumn("reread", F.lit(False))
    return kept.unionByName(again.select(*items.columns).join(chosen, key, "left_semi").withColumn("reread", F.lit(True)))

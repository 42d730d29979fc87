"""Readers of declarations, journals, orders and bills of lading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: An item of a declaration and its tax lines.
ITEM_SCHEMA = """
    Item_number int, Commodity_code string, Precision_4 string, Description string, Quantity double, CIF_value double,
    Tax array<struct<Code: string, Base: double, Rate: double, Amount: double>>
"""


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def declaration_items(spark: SparkSession, path: str, row_tag: str = "Item") -> DataFrame:
    """Items of declarations in XML files (a folder or a glob), with their file and taxes as an array; short codes are filled to
    eight digits with zeros."""
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(ITEM_SCHEMA).load(path)
    code = F.regexp_replace(F.coalesce("Commodity_code", F.lit("")), "[^0-9]", "")
    filled = F.when(F.length(code).between(6, 7), F.rpad(code, 8, "0")).otherwise(code)
    return raw.select(
        F.input_file_name().alias("file"), F.col("Item_number").alias("item_id"), filled.alias("tariff_code"), F.col("Description").alias("description"),
        F.col("Quantity").alias("quantity"), F.col("CIF_value").cast("decimal(18,2)").alias("cif"), F.coalesce("Tax", F.array()).alias("taxes"),
    )


def tax_lines(items: DataFrame) -> DataFrame:
    each = items.select("file", "item_id", F.explode("taxes").alias("t"))
    return each.select("file", "item_id", F.col("t.Code").alias("tax_code"), F.col("t.Base").alias("base"), F.col("t.Rate").alias("rate"), F.col("t.Amount").cast("decimal(18,2)").alias("amount"))


def journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of line-delimited JSON files; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def layout(header: Column) -> Column:
    """The layout of an order sheet by its header row (an array of cells)."""
    low = F.transform(header, lambda h: F.lower(F.trim(h)))
    commercial = (F.get(low, 0) == "number") & F.exists(low, lambda h: F.contains(h, F.lit("invoice lines")))
    return F.when(commercial, "commercial_invoice").otherwise("classic")


def classic_orders(rows: DataFrame) -> DataFrame:
    """Order rows of the classic layout (sheet, row, partner, reference, description, demand, price): the partner is carried down, the
    reference ``PO/GD/n (a/b)`` gives order and invoice references, a bracket in front of the description is the supplier's SKU."""
    down = Window.partitionBy("sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("supplier", F.last("partner", ignorenulls=True).over(down)).withColumn("ref", F.last("reference", ignorenulls=True).over(down))
    refs = F.regexp_extract("ref", r"\(([^)]*)\)", 1)
    return out.filter(F.col("description").isNotNull() & F.col("demand").isNotNull()).select(
        "sheet", "row", "supplier", F.trim(F.regexp_replace("ref", r"\(.*$", "")).alias("po_number"),
        _trimmed(F.split(refs, "/")).alias("invoice_refs"), F.nullif(F.regexp_extract("description", r"^\[([^\]]+)\]", 1), F.lit("")).alias("supplier_sku"),
        F.trim(F.regexp_replace("description", r"^\[[^\]]+\]", "")).alias("description"), "demand", F.col("price").alias("unit_price"), (F.col("demand") * F.col("price")).cast("decimal(18,2)").alias("total"),
    )


def commercial_orders(rows: DataFrame) -> DataFrame:
    """Order rows of a commercial invoice (sheet, row, number, partner, product, quantity, price): number and partner are carried down;
    rows without product or quantity are dropped."""
    down = Window.partitionBy("sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({c: F.last(c, ignorenulls=True).over(down) for c in ("number", "partner")}).filter(F.col("product").isNotNull() & F.col("quantity").isNotNull())
    return out.select("sheet", "row", F.col("partner").alias("supplier"), F.col("number").alias("po_number"), F.array("number").alias("invoice_refs"), F.col("product").alias("description"), F.col("quantity").alias("demand"), F.col("price").alias("unit_price"), (F.col("quantity") * F.col("price")).cast("decimal(18,2)").alias("total"))


def bills_of_lading(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with bl_number, consignee, packages (before the first total line, 1 if none), weight_kg (pounds cut to whole kilograms)
    and references (comma list that may go on in the next line)."""
    body = F.substring_index(F.upper(F.col(text)), "TOTAL", 1)
    counts = F.transform(F.regexp_extract_all(body, F.lit(r"(\d+)\s+(?:PACKAGES|PKGS|CARTONS|CTNS)\b"), F.lit(1)), lambda n: n.cast("long"))
    pounds = F.regexp_extract(text, r"(?i)([\d,]+(?:\.\d+)?)\s*LBS?\b", 1)
    listed = F.regexp_extract(text, r"(?i)INVOICES?[:#]\s*((?:[\w/-]+\s*,\s*)*[\w/-]+)", 1)
    return texts.withColumns({
        "bl_number": F.nullif(F.regexp_extract(text, r"(?i)B/?L\s*(?:NO\.?|#)?\s*:?\s*([A-Z]{3,}\d{5,})", 1), F.lit("")),
        "consignee": F.nullif(F.trim(F.regexp_extract(text, r"(?im)^CONSIGNEE:\s*(.+)$", 1)), F.lit("")),
        "packages": F.greatest(F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n), F.lit(1)),
        "weight_kg": (F.replace(pounds, F.lit(","), F.lit("")).try_cast("double") * 0.453592).cast("int"),
        "refs": _trimmed(F.split(listed, ",")),
    })


def supplementary_merged(bills: DataFrame) -> DataFrame:
    """One row for each bl_number: the most packages and weight, and all references."""
    return bills.filter(F.col("bl_number").isNotNull()).groupBy("bl_number").agg(
        F.max("packages").alias("packages"), F.max("weight_kg").alias("weight_kg"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs")
    )

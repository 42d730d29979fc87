"""Queries of items in sections and blocks of lines. Documents are orders, printed over pages (made up)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.operators import sections as S
from tradeloom.sources.tables import ITEMS_SQL, SEQ_SQL, invoice_items, with_seq

SPEC = S.Section(
    header=r"^Ln\s+Item\s+Qty", item=r"(\d+(?:\.\d+)?)\s+(\S+)\s+([\d,.]+)\s+x\s+([\d,.?]+)(?:\s+=\s+([\d,.]+))?$", fields={"line_number": 1, "sku": 2, "quantity": 3, "unit_price": 4, "total": 5},
    page_marks=("Continued",), total_marks=("Subtotal", "Total"), upc=r"UPC[: ]+(\d+)", continues=True, drop_free_parts=True, drop_no_quantity=True,
)


def _lines(spark, d):
    """Two lines an item and more: the page breaks after every third item; what is outside of sections looks like items, too."""
    i = with_seq(invoice_items(spark, d)).withColumn("k", F.col("invoice_id"))
    seq, k = F.col("seq"), F.col("k")
    q, u = F.when((k + seq) % 13 == 0, F.lit("0.9")).otherwise(F.floor("quantity").cast("string")), F.format_number(F.col("unit_cost").cast("decimal(18,2)"), 2)
    number = F.concat(seq, F.when((k + seq) % 5 == 0, ".1").otherwise(""))
    total = F.when((k + seq) % 3 == 0, F.concat(F.lit(" = "), F.format_number("total_cost", 2))).when((k + seq) % 5 == 0, " = 0.00").otherwise("")
    price = F.when((k + seq) % 17 == 0, "?").otherwise(u)
    page = F.when(seq % 3 == 1, F.array(F.concat(F.lit("9 no 9 x 9.00 page "), seq), F.lit("9 no 9 x 9.00"), F.lit(" LN  Item Qty")))
    body = F.array(F.concat(F.lit(" "), number, F.lit(" "), "sku", F.lit("  "), q, F.lit(" x "), price, total), F.lit("• note"), F.col("description"), F.when(seq % 2 == 0, F.concat(F.lit("UPC: "), "part_id")), F.when(seq % 4 == 0, F.lit("and more")), F.lit(None))
    end = F.when(seq % 3 == 0, F.array(F.when(k % 2 == 0, "Continued on next").otherwise("Page 1 of 2"), F.lit("lost line")))
    each = i.select(k.alias("doc_id"), "seq", F.posexplode(F.concat(F.coalesce(page, F.array().cast("array<string>")), body, F.coalesce(end, F.array().cast("array<string>")))).alias("at", "line"))
    return each.select("doc_id", (F.col("seq") * 100 + F.col("at")).alias("line_no"), "line")


def section_items(spark, d):
    return S.section_items(_lines(spark, d), SPEC).select("doc_id", "line_number", "sku", "quantity", "unit_cost", "total_cost", "description", "upc")


def priced_products(spark, d):
    i = with_seq(invoice_items(spark, d)).withColumn("k", F.col("invoice_id"))
    seq, k = F.col("seq"), F.col("k")
    lines = F.array(F.when(k % 5 == 0, "Shop: some product").otherwise(F.concat(F.lit(" "), "description", F.lit(" "))), F.when((k + seq) % 4 == 0, "Cost: 1.00").otherwise(F.concat(F.lit("Price: $"), F.format_number("total_cost", 2))), F.lit("Size: M"), F.when(seq % 3 > 0, F.concat(F.lit("Qty: "), seq)).otherwise(""))
    return S.priced_products(i.select(k.alias("doc_id"), "seq", F.posexplode(lines).alias("at", "line")).select("doc_id", (F.col("seq") * 10 + F.col("at")).alias("line_no"), "line"))


QUERIES = {"section_items": section_items, "priced_products": priced_products}

_N = f"WITH {ITEMS_SQL}, {SEQ_SQL}, i AS (SELECT *, invoice_id AS k, floor(quantity) AS fq, CAST(unit_cost AS DECIMAL(18,2)) AS u FROM numbered)"
SQL = {
    "section_items": f"""{_N}, r AS (SELECT *, CASE WHEN (k + seq) % 13 = 0 THEN 0 ELSE CAST(fq AS BIGINT) END AS q, CASE WHEN (k + seq) % 17 = 0 THEN 0 ELSE CAST(u AS DOUBLE) END AS p FROM i),
        s AS (SELECT k AS doc_id, seq || CASE WHEN (k + seq) % 5 = 0 THEN '.1' ELSE '' END AS line_number, sku, q AS quantity, p AS unit_cost, CASE WHEN (k + seq) % 3 = 0 THEN CAST(total_cost AS DOUBLE) WHEN (k + seq) % 5 = 0 THEN 0 ELSE round(CAST(CAST(p AS DECIMAL(18,2)) * q AS DOUBLE), 2) END AS total_cost,
          description || CASE WHEN seq % 4 = 0 THEN ' and more' ELSE '' END AS description, CASE WHEN seq % 2 = 0 THEN CAST(part_id AS VARCHAR) END AS upc FROM r)
        SELECT * FROM s WHERE quantity > 0 AND (total_cost > 0 OR NOT contains(line_number, '.'))""",
    "priced_products": f"""{_N}, p AS (SELECT k AS doc_id, seq, description, CASE WHEN seq % 3 > 0 THEN seq ELSE 1 END AS quantity, CAST(total_cost AS DOUBLE) AS unit_cost, row_number() OVER (PARTITION BY k ORDER BY seq) AS item, CAST(total_cost AS DECIMAL(18,2)) AS t FROM i WHERE k % 5 > 0 AND (k + seq) % 4 > 0)
        SELECT doc_id, item, 'FN-' || item AS sku, description, quantity, unit_cost, CAST(t * quantity AS DOUBLE) AS total_cost FROM p""",
}

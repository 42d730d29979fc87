"""Queries of documents parsed by specs, and of parsers' results in one schema. Texts are orders, printed in three formats (made up)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tradeloom.operators import specs as S
from tradeloom.sources.tables import ITEMS_SQL, SEQ_SQL, invoice_items, with_seq

SPECS = [
    {
        "name": "acme", "detect": {"all_of": ["ACME Stores"], "none_of": ["refund"]}, "clean": [{"pattern": r"(\d) OF;", "replace": r"\1 of:"}],
        "section": {"start": "Items", "ends": ["Thank you"]}, "metadata": {"number": {"patterns": [r"Order no\. (\S+)"]}, "total": {"patterns": [r"Grand ([\d,]+\.\d\d)", r"Total \$([\d,]+\.\d\d)"], "type": "currency"}},
        "items": {
            "strategy": "line", "pattern": r"^(?:CANCELED )?(\d+) of: (\S+) / (.+?) / \$([\d,]+\.\d{2})$", "field_map": {"quantity": 1, "sku": 2, "description": 3, "total_cost": 4},
            "types": {"quantity": "integer", "total_cost": "currency"}, "skip_patterns": ["^canceled"], "clean_fields": {"description": [[r"\s+", " "]]},
            "generated_fields": {"unit_cost": "total_cost / quantity", "code": "A-{index:03d}", "source": "{shop} line"},
            "extra_patterns": [{"pattern": r"^Shipping \$([\d,]+\.\d{2}) (\w+)$", "field_map": {"total_cost": 1, "description": 2}}],
        },
    },
    json.dumps({
        "name": "borea", "priority": 5, "detect": {"any_of": ["Borea GmbH", "Borea AG"]}, "metadata": {"number": {"patterns": [r"Invoice: (\S+)"]}},
        "items": {
            "strategy": "block", "start": r"Item \d+$", "fields": {"sku": r"Ref (\S+)", "catalog_num": r"Catalog (\S+)", "description": r"Name (.+)", "quantity": r"Qty (\d+)", "unit_price": r"Price ([\d,.]+)"},
            "types": {"quantity": "integer", "unit_price": "currency"},
        },
    }),
    {
        "name": "cello", "source": "auto", "detect": {"any_of": ["Cello Trading"]},
        "items": {"strategy": "table", "field_map": {"description": 1, "quantity": 2, "total_cost": 3}, "header": ["Description", "Qty", "Amount"], "types": {"quantity": "integer", "total_cost": "currency"}, "generated_fields": {"sku": "CL-{index}", "unit_cost": "(total_cost - 1) / quantity + 0.5"}},
    },
    {"name": "cello", "source": "auto", "detect": {"any_of": ["never"]}, "items": {"strategy": "line", "pattern": "x", "field_map": {}}},
]


def _printed(spark, d):
    i = with_seq(invoice_items(spark, d)).withColumn("q", F.floor("quantity").cast("string"))
    k, amount = F.col("invoice_id") % 4, F.format_number("total_cost", 2)
    line = (
        F.when(k == 0, F.concat(F.when(F.col("seq") == 4, "CANCELED ").otherwise(""), "q", F.when(F.col("seq") == 2, " OF; ").otherwise(" of: "), "sku", F.lit(" / "), F.replace("description", F.lit(" "), F.lit("  ")), F.lit(" / $"), amount))
        .when(k == 1, F.concat(F.lit("Item "), "seq", F.when(F.col("seq") % 2 == 1, F.concat(F.lit("\n  Ref "), "sku")).otherwise(""), F.lit("\n  Catalog C"), "part_id", F.lit("\n  Name "), "description", F.lit("\n  Qty "), "q", F.lit("\n  Price "), F.format_number(F.col("unit_cost").cast("decimal(18,2)"), 2)))
        .otherwise(F.concat_ws("\t", "description", "q", amount))
    )
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))), lambda r: r["line"]), "\n")
    docs = i.groupBy("invoice_id").agg(body.alias("body"), F.format_number(F.sum("total_cost"), 2).alias("whole"))
    k = F.col("invoice_id") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("ACME Stores\nOrder no. A"), "invoice_id", F.lit("\n9 of: no / thing / $9.00\nItems\n"), "body", F.lit("\nShipping $4.50 parcel\nThank you\n9 of: no / thing / $9.00\nTotal $"), "whole"))
        .when(k == 1, F.concat(F.lit("Borea GmbH\nInvoice: B"), "invoice_id", F.lit("\n"), "body"))
        .when(k == 2, F.concat(F.lit("Cello Trading\nDescription\tQty\tAmount\n"), "body", F.lit("\nTotal\t1\t"), "whole"))
        .otherwise(F.concat(F.lit("Nobody knows ACME Stores, a refund\n"), "body"))
    )
    return docs.select(F.col("invoice_id").alias("doc_id"), text.alias("text"))


def spec_items(spark, d):
    found = S.items_of(S.parsed(_printed(spark, d), SPECS))
    attribute = lambda n: F.coalesce(F.col("attributes")[n], F.lit("")).alias(n)
    return found.select("doc_id", "format", "item", "sku", "description", "quantity", F.round(F.col("unit_cost").cast("decimal(28,12)"), 6).cast("double").alias("unit_cost"), "total_cost", attribute("code"), attribute("source"), attribute("catalog_num"))


def spec_heads(spark, d):
    return S.parsed(_printed(spark, d), SPECS).select("doc_id", "format", F.col("metadata")["number"].alias("number"), F.col("metadata")["total"].cast("decimal(18,2)").alias("total"), F.size("items").alias("n_items"), "skipped_total")


def _results(spark, d):
    """Results of parsers whose keys differ by order: totals under one of two keys, prices too, some keys left out or null, some not a success."""
    i = with_seq(invoice_items(spark, d))
    k, number = F.col("invoice_id"), lambda c: F.col(c).cast("double")
    q = F.when(F.col("seq") == 3, F.lit(0.0)).otherwise(number("quantity"))
    total = F.when((F.col("seq") == 3) & (k % 2 == 0), F.lit(0.0)).otherwise(number("total_cost"))
    item = F.to_json(F.struct(
        F.when(F.col("seq") != 2, F.col("sku")).alias("sku"), F.col("description"), F.when(F.col("seq") != 5, q).alias("quantity"), F.when(k % 3 == 0, total).alias("total_cost"), F.when(k % 3 > 0, total).alias("total"),
        F.when(k % 5 == 0, number("unit_cost")).alias("unit_cost"), F.when(k % 5 > 1, number("unit_cost")).alias("unit_price"),
    ))
    item = F.when((k % 3 == 1) & (F.col("seq") == 1), F.regexp_replace(item, r"\}$", ',"total_cost":null}')).otherwise(item)
    items = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", item.alias("j")))), lambda r: r["j"]), ",")
    head = F.to_json(F.struct(F.concat(F.lit("N"), "invoice_id").alias("invoice_number"), F.when(F.col("invoice_id") % 2 == 0, F.lit(12.5)).alias("total"), F.when(F.col("invoice_id") % 6 == 0, F.lit(3)).alias("tax"), F.when(F.col("invoice_id") % 4 == 0, F.lit(True)).alias("invoice_total_uncertain")))
    status = F.when(k % 11 == 0, "error").otherwise("success")
    made = i.groupBy("invoice_id").agg(items.alias("items"))
    full = F.concat(F.lit('{"status":"'), status, F.lit('","format":"f'), k % 3, F.lit('","invoices":['), F.when(k % 13 > 0, F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"items":['), "items", F.lit("]}"))).otherwise(""), F.lit("]}"))
    return made.select(k.alias("doc_id"), F.when(k % 17 == 0, F.substring(full, 1, 30)).otherwise(full).alias("result"))


def normalised_items(spark, d):
    rows = S.normalised(_results(spark, d)).select("doc_id", F.posexplode("items").alias("place", "i"))
    return rows.select("doc_id", "place", "i.supplier_item", "i.description", "i.quantity", "i.unit_price", "i.total")


def normalised_heads(spark, d):
    return S.normalised(_results(spark, d)).select("doc_id", "invoice_num", "invoice_date", "invoice_total", "tax", "freight", "invoice_total_uncertain", "format", F.size("items").alias("n_items"))


QUERIES = {"spec_items": spec_items, "spec_heads": spec_heads, "normalised_items": normalised_items, "normalised_heads": normalised_heads}

_N = "numbered AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY line, part_id, supplier_id, quantity, total_cost, billable) AS seq, floor(quantity)::DOUBLE AS q, invoice_id AS k, CAST(total_cost AS DOUBLE) AS t FROM items)"
_KEPT = f"""WITH {ITEMS_SQL}, {_N},
  r AS (SELECT k AS doc_id, seq, CASE WHEN seq = 2 THEN '' ELSE sku END AS supplier_item, description, CASE WHEN seq = 5 THEN 0 WHEN seq = 3 THEN 0 ELSE CAST(quantity AS DOUBLE) END AS quantity, CASE WHEN k % 5 = 1 THEN 0 ELSE CAST(unit_cost AS DOUBLE) END AS unit_price,
        CASE WHEN k % 3 = 1 AND seq = 1 THEN NULL WHEN seq = 3 AND k % 2 = 0 THEN 0 ELSE t END AS total FROM numbered WHERE k % 11 > 0 AND k % 13 > 0 AND k % 17 > 0),
  kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS place FROM r WHERE NOT (quantity = 0 AND coalesce(total, 0) = 0))"""
SQL = {
    "spec_items": f"""WITH {ITEMS_SQL}, {_N},
  a AS (SELECT k AS doc_id, 'acme' AS format, row_number() OVER (PARTITION BY k ORDER BY seq) AS item, sku, description, q AS quantity, CAST(round(CAST(t / q AS DECIMAL(28,12)), 6) AS DOUBLE) AS unit_cost, t AS total_cost FROM numbered WHERE k % 4 = 0 AND seq <> 4),
  n AS (SELECT doc_id, count(*) AS n FROM a GROUP BY 1)
  SELECT *, 'A-' || lpad(CAST(item AS VARCHAR), 3, '0') AS code, '{{shop}} line' AS source, '' AS catalog_num FROM a
  UNION ALL SELECT doc_id, 'acme', n + 1, NULL, 'parcel', NULL, NULL, 4.5, '', '', '' FROM n
  UNION ALL SELECT k, 'borea', seq, CASE WHEN seq % 2 = 1 THEN sku ELSE 'C' || part_id END, description, q, CAST(CAST(unit_cost AS DECIMAL(18,2)) AS DOUBLE), round(CAST(CAST(unit_cost AS DECIMAL(18,2)) * CAST(q AS INT) AS DOUBLE), 2), '', '', 'C' || part_id FROM numbered WHERE k % 4 = 1
  UNION ALL SELECT k, 'cello', seq, 'CL-' || seq, description, q, CAST(round(CAST((t - 1) / q + 0.5 AS DECIMAL(28,12)), 6) AS DOUBLE), t, '', '', '' FROM numbered WHERE k % 4 = 2""",
    "spec_heads": f"""WITH {ITEMS_SQL}, {_N}, g AS (SELECT k, count(*) AS n, sum(total_cost) AS whole, count(*) FILTER (seq = 4) AS gone, coalesce(sum(t) FILTER (seq = 4), 0) AS skipped FROM numbered GROUP BY 1)
  SELECT k AS doc_id, CASE k % 4 WHEN 0 THEN 'acme' WHEN 1 THEN 'borea' WHEN 2 THEN 'cello' END AS format, CASE k % 4 WHEN 0 THEN 'A' || k WHEN 1 THEN 'B' || k END AS number, CASE WHEN k % 4 = 0 THEN CAST(whole AS DECIMAL(18,2)) END AS total,
    CASE k % 4 WHEN 0 THEN n - gone + 1 WHEN 3 THEN NULL ELSE n END AS n_items, CASE k % 4 WHEN 0 THEN round(skipped, 2) WHEN 3 THEN NULL ELSE 0 END AS skipped_total FROM g""",
    "normalised_items": f"{_KEPT} SELECT doc_id, place, supplier_item, description, quantity, unit_price, total FROM kept",
    "normalised_heads": f"""{_KEPT}, n AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY 1), o AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), f AS (SELECT k, k % 11 > 0 AND k % 17 > 0 AS ok, k % 11 > 0 AND k % 17 > 0 AND k % 13 > 0 AS has FROM o)
  SELECT k AS doc_id, CASE WHEN has THEN 'N' || k ELSE '' END AS invoice_num, '' AS invoice_date, CASE WHEN has AND k % 2 = 0 THEN 12.5 ELSE 0 END AS invoice_total, CASE WHEN has AND k % 6 = 0 THEN 3 ELSE 0 END AS tax, 0 AS freight,
    has AND k % 4 = 0 AS invoice_total_uncertain, CASE WHEN ok THEN 'f' || k % 3 ELSE 'unknown' END AS format, coalesce(n, 0) AS n_items FROM f LEFT JOIN n ON doc_id = k""",
}

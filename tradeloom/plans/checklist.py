"""Queries of the shipment checklist. Shipments are orders with made-up faults that follow from their key (k); sheets and items are their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.operators import checklist as C
from tradeloom.sources.tables import ITEMS_SQL, invoice_items, table

#: Columns by expressions that both engines read.
_SHIPMENT = {
    "waybill": "CASE WHEN k % 11 = 0 THEN '' WHEN k % 13 = 0 THEN concat('B', k % 1000) WHEN k % 7 = 0 THEN concat('HAWB', k, '-Declaration') ELSE concat('HAWB', k, '00') END",
    "weight": "CASE WHEN k % 17 = 0 THEN 'n/a' WHEN k % 19 = 0 THEN '0' ELSE concat(k % 90 + 1, '.5') END",
    "packages": "CASE WHEN k % 23 = 0 THEN '2.0' WHEN k % 29 = 0 THEN NULL ELSE concat(' ', k % 6) END",
    "freight": "CASE WHEN k % 5 = 0 THEN '' ELSE concat(k % 9, '') END",
    "consignee_name": "CASE WHEN k % 31 = 0 THEN 'To Order' WHEN k % 37 = 0 THEN repeat('xy ', 40) WHEN k % 47 = 0 THEN NULL ELSE concat('Customer ', o_custkey) END",
    "consignee_address": "CASE WHEN k % 41 = 0 THEN repeat('long ', 50) ELSE concat('street ', k) END",
    "consignee_known": "o_custkey % 10 > 0",
    "total_invoices": "k % 3",
    "expected_entries": "CASE WHEN k % 8 = 0 THEN 'x' WHEN k % 8 = 1 THEN '' ELSE '1' END",
    "country_origin": "CASE WHEN k % 12 = 0 THEN 'USA' WHEN k % 12 = 1 THEN '' ELSE 'US' END",
    "man_reg": "CASE WHEN k % 20 = 0 THEN '' WHEN k % 20 = 1 THEN '24 19' WHEN k % 20 = 2 THEN '2024/19' ELSE concat('2024 ', k % 50) END",
    "packages_found": "k % 6",
    "packages_expected": "k % 6 + CASE WHEN k % 25 = 0 THEN 1 ELSE 0 END",
    "packages_source": "CASE WHEN k % 50 = 0 THEN 'default (1 per entry)' ELSE 'bill' END",
    "content_duplicates": "CASE WHEN k % 27 = 0 THEN 1 ELSE 0 END",
}
#: Attached files: path, when it is attached, and when it was found.
_ATTACHED = [
    ("concat('out/', k, '.xlsx')", "true", "true"), ("concat('out/', k, '.pdf')", "true", "k % 16 > 0"), ("concat('out/WorkSheet ', k, '.pdf')", "k % 4 = 0", "true"),
    ("concat('/tmp/x/', k, '.xlsx')", "k % 6 = 0", "true"), ("concat('out/Z', k, '.XLSX')", "k % 10 = 0", "true"), ("concat('out/HAWB', k, '.xlsx')", "k % 14 = 0", "true"), ("'out/all_combined.xlsx'", "k % 15 = 0", "k % 45 > 0"),
]
_ITEM = {
    "description": "CASE (k + line) % 31 WHEN 1 THEN 'Paid by PayPal' WHEN 2 THEN '12345678 bolts' WHEN 3 THEN 'Temu purchase' WHEN 4 THEN 'abc' WHEN 5 THEN 'eeee' WHEN 6 THEN 'the same thing' ELSE description END",
    "sku": "CASE WHEN (k + line) % 37 = 0 THEN 'item-17' WHEN (k + line) % 41 = 0 THEN tariff_code ELSE sku END",
    "tariff_code": "tariff_code",
    "quantity": "CASE WHEN (k + line) % 43 = 0 THEN 0 ELSE quantity END",
    "unit_cost": "CASE WHEN (k + line) % 31 IN (5, 6) THEN 2.5 ELSE unit_cost END",
    "total_cost": "total_cost",
}
_SHEET = "concat(k, CASE WHEN k % 9 = 4 THEN '-combined' ELSE '' END, '-', line % 2, '.xlsx')"
_FILE = {
    "invoice_total": "CASE WHEN k % 33 = 0 THEN 0 ELSE sum(total_cost) END",
    "estimated": "CASE WHEN k % 35 > 0 THEN sum(total_cost) END",
    "declared": "CASE k % 9 WHEN 0 THEN NULL WHEN 1 THEN 2 * sum(total_cost) WHEN 2 THEN 1.4 * sum(total_cost) ELSE sum(total_cost) END",
    "format_source": "CASE WHEN max(line) = 7 THEN 'llm_auto' ELSE 'spec' END",
}
_ISSUE = "CASE WHEN l_partkey % 50 = 0 THEN 'INVALID_TARIFF' WHEN l_suppkey % 7 = 0 THEN 'VARIANCE' WHEN l_partkey % 60 = 1 THEN 'ZERO_VALUE' END"


def _listed(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {name}" for name, e in columns.items()]


def _inputs(spark, d):
    items = invoice_items(spark, d).withColumn("k", F.col("invoice_id"))
    files = items.groupBy("k", F.expr(_SHEET).alias("file")).agg(*map(F.expr, _listed(_FILE))).withColumnRenamed("k", "shipment_id")
    rows = items.selectExpr("k AS shipment_id", f"{_SHEET} AS file", *_listed(_ITEM))
    issues = table(spark, d, "lineitem").selectExpr("l_orderkey AS shipment_id", f"{_ISSUE} AS type", "l_linenumber % 2 = 0 AS in_block").filter("type IS NOT NULL")
    left = issues.groupBy("shipment_id").agg(F.count("*").alias("unfixed"), F.collect_list(F.struct("type", "in_block")).alias("remaining"))
    attached = F.array_compact(F.array(*[F.when(F.expr(when), F.struct(F.expr(path).alias("path"), F.expr(found).alias("found"))) for path, when, found in _ATTACHED]))
    orders = table(spark, d, "orders").withColumn("k", F.col("o_orderkey"))
    shipments = orders.select(F.col("k").alias("shipment_id"), *map(F.expr, _listed(_SHIPMENT)), F.when(F.col("k") % 43 > 0, attached).alias("attachments"))
    return shipments.join(left, "shipment_id", "left"), files, rows


def every_check(spark, d):
    """Every check of every shipment."""
    return C.checked(*_inputs(spark, d))


def shipment_gate(spark, d):
    return C.gated(*_inputs(spark, d))


QUERIES = {"shipment_checklist": every_check, "shipment_gate": shipment_gate}

_ROWS_SQL = f"""WITH {ITEMS_SQL},
  it AS (SELECT *, invoice_id AS k FROM items),
  s AS (SELECT k AS shipment_id, k, {", ".join(_listed(_SHIPMENT))},
        CASE WHEN k % 43 > 0 THEN list_filter([{", ".join(f"CASE WHEN {w} THEN {{'p': {p}, 'f': {f}}} END" for p, w, f in _ATTACHED)}], lambda x: x IS NOT NULL) ELSE [] END AS att FROM (SELECT *, o_orderkey AS k FROM orders)),
  left_over AS (SELECT l_orderkey AS shipment_id, count(*) AS unfixed, count(*) FILTER ({_ISSUE} = 'INVALID_TARIFF') AS tariffs, count(*) FILTER ({_ISSUE} = 'VARIANCE') AS variances,
        coalesce(bool_or(l_linenumber % 2 = 0) FILTER ({_ISSUE} = 'VARIANCE'), false) AS in_block FROM lineitem WHERE {_ISSUE} IS NOT NULL GROUP BY 1),
  files AS (SELECT k AS shipment_id, {_SHEET} AS file, {", ".join(_listed(_FILE))} FROM it GROUP BY k, file),
  fc AS (SELECT shipment_id, count(*) FILTER (invoice_total <= 0) AS negative_invoice_total, count(*) FILTER (format_source = 'llm_auto') AS llm_auto_format_used,
        count(*) FILTER (estimated IS NOT NULL AND declared IS NULL) AS client_declared_duties_missing, count(*) FILTER (2 * abs(declared - estimated) > greatest(estimated, 1)) AS client_declared_duties_variance_excessive
        FROM files WHERE NOT contains(file, '-combined') GROUP BY 1),
  ri AS (SELECT k AS shipment_id, {_SHEET} AS file, {", ".join(_listed(_ITEM))} FROM it),
  ri2 AS (SELECT * FROM ri WHERE NOT contains(file, '-combined')),
  dup AS (SELECT shipment_id, count(*) AS duplicate_items_in_xlsx FROM (SELECT shipment_id FROM ri2 WHERE unit_cost > 0 GROUP BY shipment_id, file, lower(description), round(CAST(unit_cost AS DECIMAL(18,4)), 2) HAVING count(*) > 1) GROUP BY 1),
  ic AS (SELECT shipment_id, count(*) FILTER (sku = 'item-17') AS placeholder_sku, count(*) FILTER (contains(description, 'PayPal')) AS payment_line_as_item, count(*) FILTER (description = '12345678 bolts') AS description_starts_with_tariff,
        count(*) FILTER (description = 'Temu purchase') AS generic_purchase_description, count(*) FILTER (length(trim(description)) < 5) AS description_too_short, count(*) FILTER (description = 'eeee') AS garbage_description_pattern,
        count(*) FILTER (quantity = 0 AND total_cost > 0) AS quantity_zero_with_cost FROM ri2 GROUP BY 1),
  j AS (SELECT s.*, coalesce(unfixed, 0) AS unfixed, coalesce(tariffs, 0) AS tariffs, coalesce(variances, 0) AS variances, coalesce(in_block, false) AS in_block, trim(coalesce(waybill, '')) AS wb, trim(coalesce(consignee_name, '')) AS cn, trim(consignee_address) AS ca,
        coalesce(trim(packages), '') AS pk, list_transform(att, lambda a: a.p) AS paths, list_transform(att, lambda a: regexp_extract(a.p, '[^/]*$')) AS names,
        {", ".join(f"coalesce({k}, 0) AS {k}" for k in C.SHEET_CHECKS)} FROM s LEFT JOIN left_over USING (shipment_id) LEFT JOIN fc USING (shipment_id) LEFT JOIN ic USING (shipment_id) LEFT JOIN dup USING (shipment_id)),
  x AS (SELECT *, list_filter(names, lambda n: lower(n) LIKE '%.xlsx') AS sheets, list_transform(list_filter(names, lambda n: lower(n) LIKE '%.pdf'), lambda n: n[:-5]) AS printed FROM j),
  y AS (SELECT *, len(list_filter(list_transform(sheets, lambda n: n[:-6]), lambda t: NOT (t LIKE '%\\_combined' ESCAPE '\\') AND NOT regexp_matches(t, '^HAWB[0-9]') AND NOT list_contains(printed, t))) AS alone,
        len(list_filter(att, lambda a: NOT a.f)) AS lost, len(list_filter(names, lambda n: n LIKE 'WorkSheet%')) AS ws, len(list_filter(paths, lambda n: contains(n, '/tmp/'))) AS stale, len(names) - len(list_distinct(names)) AS again FROM x),
  r AS (SELECT shipment_id, unnest([
    {{'c': 'waybill_missing', 's': 'block', 'f': 'waybill', 'x': wb = '', 'k': false, 'v': wb}}, {{'c': 'waybill_short', 's': 'warn', 'f': 'waybill', 'x': length(wb) < 6, 'k': wb = '', 'v': wb}},
    {{'c': 'weight_zero', 's': 'block', 'f': 'weight', 'x': weight IN ('n/a', '0'), 'k': false, 'v': weight}}, {{'c': 'packages_zero', 's': 'block', 'f': 'packages', 'x': pk IN ('', '0', '2.0'), 'k': false, 'v': pk}},
    {{'c': 'freight_zero', 's': 'warn', 'f': 'freight', 'x': freight IN ('', '0'), 'k': false, 'v': freight}}, {{'c': 'consignee_missing', 's': 'block', 'f': 'consignee_name', 'x': cn IN ('', 'To Order'), 'k': false, 'v': cn}},
    {{'c': 'consignee_name_garbage', 's': 'block', 'f': 'consignee_name', 'x': length(cn) > 60, 'k': false, 'v': cn[:80]}}, {{'c': 'consignee_address_garbage', 's': 'block', 'f': 'consignee_address', 'x': length(ca) > 200, 'k': false, 'v': ca[:80]}},
    {{'c': 'no_invoices', 's': 'block', 'f': 'total_invoices', 'x': total_invoices < 1, 'k': false, 'v': CAST(total_invoices AS VARCHAR)}}, {{'c': 'no_attachments', 's': 'block', 'f': 'attachment_paths', 'x': len(att) = 0, 'k': false, 'v': '[]'}},
    {{'c': 'missing_attachments', 's': 'block', 'f': 'attachment_paths', 'x': lost > 0, 'k': len(att) = 0, 'v': CAST(lost AS VARCHAR)}}, {{'c': 'unfixed_tariff', 's': 'block', 'f': 'validation.tariff', 'x': tariffs > 0, 'k': false, 'v': CAST(tariffs AS VARCHAR)}},
    {{'c': 'unfixed_variance', 's': CASE WHEN in_block THEN 'warn' ELSE 'block' END, 'f': 'validation.variance', 'x': variances > 0, 'k': false, 'v': CAST(variances AS VARCHAR)}},
    {{'c': 'package_mismatch', 's': 'block', 'f': 'packages', 'x': k % 25 = 0 AND k % 50 > 0, 'k': false, 'v': CAST(packages_found AS VARCHAR)}}, {{'c': 'duplicate_content', 's': 'block', 'f': 'validation.duplicates', 'x': content_duplicates > 0, 'k': false, 'v': CAST(content_duplicates AS VARCHAR)}},
    {{'c': 'bl_has_doc_suffix', 's': 'warn', 'f': 'waybill', 'x': wb LIKE '%-Declaration', 'k': false, 'v': wb}},
    {{'c': 'expected_entries_mismatch', 's': 'warn', 'f': 'expected_entries', 'x': k % 8 > 1 AND len(sheets) > 1, 'k': false, 'v': CASE WHEN k % 8 > 1 THEN '1' ELSE '' END}},
    {{'c': 'worksheet_pdf_in_attachments', 's': 'warn', 'f': 'attachment_paths', 'x': ws > 0, 'k': false, 'v': CAST(ws AS VARCHAR)}}, {{'c': 'stale_tmp_path', 's': 'block', 'f': 'attachment_paths', 'x': stale > 0, 'k': false, 'v': CAST(stale AS VARCHAR)}},
    {{'c': 'duplicate_attachment_basenames', 's': 'block', 'f': 'attachment_paths', 'x': again > 0, 'k': false, 'v': CAST(again AS VARCHAR)}}, {{'c': 'xlsx_without_source_pdf', 's': 'warn', 'f': 'attachment_paths', 'x': alone > 0, 'k': false, 'v': CAST(alone AS VARCHAR)}},
    {{'c': 'country_origin_invalid', 's': 'warn', 'f': 'country_origin', 'x': country_origin = 'USA', 'k': false, 'v': country_origin}}, {{'c': 'man_reg_blank', 's': 'warn', 'f': 'man_reg', 'x': man_reg = '', 'k': false, 'v': man_reg}},
    {{'c': 'man_reg_invalid', 's': 'warn', 'f': 'man_reg', 'x': man_reg = '24 19', 'k': man_reg = '', 'v': man_reg}}, {{'c': 'consignee_unrecognised', 's': 'block', 'f': 'consignee_name', 'x': cn <> '' AND NOT consignee_known, 'k': false, 'v': cn}},
    {", ".join(f"{{'c': '{'' if k.startswith('client') else 'item_'}{k}', 's': '{'block' if k in C.BLOCKING else 'warn'}', 'f': 'xlsx_items.{k}', 'x': {k} > 0, 'k': false, 'v': CAST({k} AS VARCHAR)}}" for k in C.SHEET_CHECKS)}]) AS c FROM y),
  checks AS (SELECT shipment_id, c.c AS "check", c.s AS severity, c.f AS field, CASE WHEN c.k THEN 'skipped' WHEN c.x THEN 'failed' ELSE 'passed' END AS status, c.v AS value FROM r)"""

SQL = {
    "shipment_checklist": f"{_ROWS_SQL} SELECT * FROM checks",
    "shipment_gate": f"""{_ROWS_SQL} SELECT shipment_id, count(*) FILTER (status = 'failed' AND severity = 'block') AS blocker_count, count(*) FILTER (status = 'failed' AND severity = 'warn') AS warning_count,
        coalesce(string_agg("check", ',' ORDER BY "check") FILTER (status = 'failed' AND severity = 'block'), '') AS blockers, count(*) FILTER (status = 'failed' AND severity = 'block') = 0 AS passed FROM checks GROUP BY 1""",
}

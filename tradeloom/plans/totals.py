"""Grouping and reconciliation queries over invoices (orders) and items (lines)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.operators import reconcile as R
from tradeloom.sources.tables import INVOICES_SQL, ITEMS_SQL, SEQ_SQL, invoice_items, invoices, table, with_seq


def group_totals(spark, d):
    """Groups of each invoice with the invoice's variance: the flagship."""
    groups = R.by_tariff(invoice_items(spark, d), all_rows=False)
    return groups.join(R.reconciled(invoices(spark, d), invoice_items(spark, d)).select("invoice_id", "variance", "balanced"), "invoice_id")


def by_tariff_v1(spark, d):
    return R.by_tariff(invoice_items(spark, d))


def worksheet(spark, d):
    return R.group_and_details(invoice_items(spark, d))


def reconcile(spark, d):
    return R.reconciled(invoices(spark, d), invoice_items(spark, d))


def grand(spark, d):
    return R.grand_totals(reconcile(spark, d), invoices(spark, d))


def buckets(spark, d):
    return R.variance_buckets(reconcile(spark, d))


def credits(spark, d):
    m = "decimal(18,2)"
    made = invoices(spark, d).select("invoice_id", F.col("invoice_total"), (F.col("invoice_total") - F.col("tax")).cast(m).alias("subtotal"), "tax", F.col("freight").alias("shipping"), "discount", F.when(F.col("invoice_id") % 4 == 0, F.col("invoice_total")).otherwise(F.lit(3)).cast(m).alias("credits"))
    return R.neutral_credits(made).select("invoice_id", "invoice_total", "credits")


def _rates(spark, d):
    p = F.col("p_partkey") % 40
    code = F.lpad((p * 2300017 + 1010000).cast("string"), 8, "0").alias("tariff_code")
    return table(spark, d, "part").select(code, p.alias("p")).distinct().filter("p % 4 > 0").select("tariff_code", (F.col("p") / 100).alias("rate"))


def weighted(spark, d):
    return R.weighted_rate(invoice_items(spark, d), _rates(spark, d))


def duty(spark, d):
    totals = R.items_total(invoice_items(spark, d)).join(invoices(spark, d), "invoice_id")
    return R.estimated_duties(totals, weighted(spark, d))


def reverse(spark, d):
    from tradeloom.functions.money import value_behind

    zero = F.lit(0.0)
    return table(spark, d, "orders").select("o_orderkey", value_behind(F.col("o_totalprice"), F.lit(0.2), (F.col("o_orderkey") % 50).cast("double"), zero).alias("items_value"))


def declared(spark, d):
    rows = duty(spark, d).withColumn("declared", F.when(F.col("invoice_id") % 3 == 0, F.lit(None)).when(F.col("invoice_id") % 3 == 1, F.col("duties")).otherwise(F.col("duties") * 2).cast("decimal(18,2)"))
    return R.declared_check(rows, "declared", "duties").groupBy("finding").agg(F.count("*").alias("n"))


def prorate(spark, d):
    rows = invoices(spark, d).select("client_id", "invoice_id", "invoice_total")
    return R.prorated(rows, "client_id", (F.col("client_id") % 97 + 1), "invoice_total", "freight")


def apportion(spark, d):
    rows = invoice_items(spark, d).select("invoice_id", "line", "part_id", "tariff_code", "total_cost", F.lit("25.50").cast("decimal(18,2)").alias("group_tax"), (F.col("invoice_id") % 50).cast("decimal(18,2)").alias("overhead"))
    return R.apportioned(rows).groupBy("invoice_id").agg(F.sum("price").cast("decimal(18,2)").alias("price"), F.count("*").alias("n"))


def candidates(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_type", F.concat_ws(" ", "p_name", F.lower("p_type"), "p_size").alias("text"))
    return R.rule_candidates(p, "p_brand", "p_type", "text")


def _shipment_items(spark, d):
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    code = F.lpad((F.col("l_partkey") % 40).cast("string"), 8, "1")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("shipment_id"), code.alias("pipeline_code"), F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, code).otherwise("99999999").alias("officer_code"),
        F.col("l_shipdate"), F.concat(F.lit("s"), F.col("l_suppkey") % 4).alias("source"), F.col("l_discount").alias("confidence"),
    )


def summary(spark, d):
    return R.shipment_summary(table(spark, d, "orders").select(F.col("o_orderkey").alias("shipment_id")), _shipment_items(spark, d))


def accuracy(spark, d):
    return R.source_accuracy(_shipment_items(spark, d))


def taxes(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.element_at(F.array(*map(F.lit, ("CET", "CSC", "VAT", "EXT"))), F.col("l_linenumber") % 4 + 1).alias("tax_code"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    return R.tax_pivot(lines, ["CET", "CSC", "VAT"])


def charges(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").cast("decimal(18,2)").alias("charge"))
    return R.closest_charge(c, table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").alias("target")), "k")


def salvage(spark, d):
    m = "decimal(18,2)"
    k = F.col("invoice_id") % 4
    rows = reconcile(spark, d).join(invoices(spark, d).select("invoice_id", "invoice_total"), "invoice_id")
    rows = rows.select("invoice_id", F.when(k > 0, F.col("invoice_total")).alias("invoice_total"), F.when(F.col("invoice_id") % 8 == 0, F.lit(100)).cast(m).alias("subtotal"), "items_total", "adjustments")
    return R.salvaged_total(rows).select("invoice_id", "invoice_total", "uncertain")


def first_rows(spark, d):
    items = with_seq(invoice_items(spark, d)).join(invoices(spark, d).select("invoice_id", "invoice_total", "freight"), "invoice_id")
    out = R.first_row_only(items.select("invoice_id", "seq", "total_cost", "invoice_total", "freight"), ["invoice_total", "freight"])
    return out.groupBy("invoice_id").agg(F.count("invoice_total").alias("filled"), F.max("freight").alias("freight"), F.count("*").alias("n"))


QUERIES = {
    "group_totals": group_totals,
    "group_by_tariff": by_tariff_v1,
    "group_and_details": worksheet,
    "reconcile": reconcile,
    "grand_totals": grand,
    "variance_bucket": buckets,
    "credit_neutralisation": credits,
    "weighted_rate": weighted,
    "duty_estimate": duty,
    "reverse_duty": reverse,
    "declared_duty_check": declared,
    "prorate": prorate,
    "cost_apportion": apportion,
    "rule_extraction": candidates,
    "shipment_summary": summary,
    "source_accuracy": accuracy,
    "tax_pivot": taxes,
    "closest_charge": charges,
    "total_salvage": salvage,
    "first_group_only": first_rows,
}

_M = "DECIMAL(18,2)"
_TOTALS = f"totals AS (SELECT invoice_id, CAST(sum(total_cost) AS {_M}) AS items_total FROM items WHERE billable GROUP BY 1)"
_REC = f"""{_TOTALS}, r1 AS (SELECT invoices.*, coalesce(items_total, 0) AS items_total, CAST(freight + insurance + tax + other_cost - discount - free_shipping AS {_M}) AS adjustments FROM invoices LEFT JOIN totals USING (invoice_id)),
r2 AS (SELECT *, CAST(items_total + adjustments AS {_M}) AS net, CASE WHEN coalesce(invoice_total, 0) = 0 THEN 0 ELSE CAST(invoice_total - items_total - adjustments AS {_M}) END AS variance FROM r1),
rec AS (SELECT *, abs(variance) <= 0.01 AS balanced, CASE {" ".join(f"WHEN abs({n}) > 0 AND abs({n} - abs(variance)) <= 0.01 THEN '{n}'" for n in ("freight", "insurance", "tax", "other_cost", "discount"))} END AS explained_by FROM r2)"""
_BASE = f"WITH {ITEMS_SQL}, {INVOICES_SQL}"
_RATES_SQL = "rates AS (SELECT DISTINCT lpad(CAST((p_partkey % 40) * 2300017 + 1010000 AS VARCHAR), 8, '0') AS tariff_code, CAST((p_partkey % 40) / 100 AS DECIMAL(10,6)) AS rate FROM part WHERE (p_partkey % 40) % 4 > 0)"
_WEIGHTED = f"""{_RATES_SQL}, wr AS (SELECT invoice_id, CAST(round(CAST(CASE WHEN sum(total_cost) = 0 THEN 0.2 ELSE CAST(sum(CAST(total_cost * coalesce(rate, 0.2) AS DECIMAL(24,8))) AS DOUBLE) / CAST(sum(total_cost) AS DOUBLE) END AS DECIMAL(20,10)), 6) AS DOUBLE) AS rate
  FROM items LEFT JOIN rates USING (tariff_code) GROUP BY 1)"""
_ROUND = lambda x: f"CAST(round(CAST({x} AS DECIMAL(28,8)), 2) AS {_M})"
_DUTY = f"""{_TOTALS}, {_WEIGHTED},
  d1 AS (SELECT invoice_id, wr.rate, {_ROUND(f"CAST(items_total + freight + insurance AS {_M}) * CAST(2.7169 AS DECIMAL(10,6))")} AS cif_local FROM totals JOIN invoices USING (invoice_id) JOIN wr USING (invoice_id)),
  d2 AS (SELECT *, {_ROUND("cif_local * CAST(rate AS DECIMAL(10,6))")} AS customs, {_ROUND("cif_local * CAST(0.06 AS DECIMAL(10,6))")} AS service FROM d1),
  d3 AS (SELECT *, {_ROUND(f"CAST(cif_local + customs + service AS {_M}) * CAST(0.15 AS DECIMAL(10,6))")} AS vat FROM d2),
  duty AS (SELECT invoice_id, cif_local, customs, service, vat, CAST(customs + service + vat AS {_M}) AS duties FROM d3)"""
_SHIP = """ship AS (SELECT l_orderkey AS shipment_id, lpad(CAST(l_partkey % 40 AS VARCHAR), 8, '1') AS pipeline_code, CASE (l_orderkey * 7 + l_linenumber) % 3 WHEN 1 THEN lpad(CAST(l_partkey % 40 AS VARCHAR), 8, '1') WHEN 2 THEN '99999999' END AS officer_code,
  's' || l_suppkey % 4 AS source, l_discount AS confidence FROM lineitem)"""
_GROUP = """SELECT invoice_id, tariff_code, CAST(coalesce(sum(quantity) FILTER (billable), 0) AS DECIMAL(18,4)) AS quantity, CAST(coalesce(sum(total_cost) FILTER (billable), 0) AS DECIMAL(18,2)) AS cost, count(*) AS item_count,
  CAST(coalesce(sum(total_cost) FILTER (NOT billable), 0) AS DECIMAL(18,2)) AS other_cost, min(line) AS first_line,
  CAST(coalesce((2 * 1000000 * CAST(100 * sum(total_cost) FILTER (billable) AS HUGEINT) + CAST(10000 * sum(quantity) FILTER (billable) AS HUGEINT)) // (2 * CAST(10000 * sum(quantity) FILTER (billable) AS HUGEINT)), 0) / 10000 AS DECIMAL(18,4)) AS average FROM items"""

SQL = {
    "group_totals": f"{_BASE}, {_REC}, g AS ({_GROUP} WHERE billable GROUP BY 1, 2) SELECT g.* EXCLUDE (other_cost), variance, balanced FROM g JOIN rec USING (invoice_id)",
    "group_by_tariff": f"WITH {ITEMS_SQL} {_GROUP} GROUP BY 1, 2",
    "group_and_details": f"""WITH {ITEMS_SQL}, u AS (SELECT invoice_id, tariff_code, NULL AS line, 'group' AS row_type, sum(quantity) AS q, sum(total_cost) AS c, count(*) AS n FROM items GROUP BY 1, 2
        UNION ALL SELECT invoice_id, tariff_code, line, 'detail', sum(quantity), sum(total_cost), count(*) FROM items GROUP BY 1, 2, 3)
        SELECT invoice_id, tariff_code, line, row_type, CAST(q AS DECIMAL(18,4)) AS quantity, CAST(c AS {_M}) AS cost, CASE WHEN row_type = 'group' THEN CASE WHEN n > 1 THEN '(+' || (n - 1) || ' more) (' || n || ' items)' ELSE '' END END AS label FROM u""",
    "reconcile": f"{_BASE}, {_REC} SELECT invoice_id, items_total, adjustments, net, variance, balanced, explained_by FROM rec",
    "grand_totals": f"{_BASE}, {_REC} SELECT client_id, CAST(sum(net) AS {_M}) AS net, CAST(sum(variance) AS {_M}) AS variance, count(*) AS invoices FROM rec GROUP BY ROLLUP (client_id)",
    "variance_bucket": f"""{_BASE}, {_REC} SELECT CASE WHEN abs(variance) <= 0.01 THEN 'balanced' WHEN abs(variance) <= 0.5 THEN 'rounding' WHEN abs(variance) <= 100 THEN 'small' WHEN abs(variance) <= 10000 THEN 'medium' ELSE 'large' END AS bucket,
        count(*) AS n, CAST(sum(abs(variance)) AS {_M}) AS total FROM rec GROUP BY 1""",
    "credit_neutralisation": f"WITH {INVOICES_SQL}, c AS (SELECT *, invoice_total - tax AS subtotal, CASE WHEN invoice_id % 4 = 0 THEN invoice_total ELSE 3 END AS credits FROM invoices), p AS (SELECT *, credits >= subtotal - 0.50 AS paid FROM c) "
    f"SELECT invoice_id, CAST(CASE WHEN paid THEN subtotal + tax + freight - discount ELSE invoice_total END AS {_M}) AS invoice_total, CAST(CASE WHEN paid THEN 0 ELSE credits END AS {_M}) AS credits FROM p",
    "weighted_rate": f"{_BASE}, {_WEIGHTED} SELECT * FROM wr",
    "duty_estimate": f"{_BASE}, {_DUTY} SELECT * FROM duty",
    "reverse_duty": f"SELECT o_orderkey, greatest({_ROUND('o_totalprice / (1.15 * 0.2 + 0.219) / 2.7169 - o_orderkey % 50')}, 0) AS items_value FROM orders",
    "declared_duty_check": f"""{_BASE}, {_DUTY}, x AS (SELECT *, CASE invoice_id % 3 WHEN 1 THEN duties WHEN 2 THEN duties * 2 END AS declared FROM duty)
        SELECT CASE WHEN declared IS NULL THEN 'MISSING_DECLARED' WHEN abs(declared - duties) / greatest(duties, 1) > 0.5 THEN 'DECLARED_OFF' END AS finding, count(*) AS n FROM x GROUP BY 1""",
    "prorate": f"""WITH {INVOICES_SQL}, s AS (SELECT client_id, invoice_id, invoice_total, CAST(client_id % 97 + 1 AS DECIMAL(18,4)) AS amount, CAST(100 * sum(invoice_total) OVER (PARTITION BY client_id) AS HUGEINT) AS w, CAST(100 * invoice_total AS HUGEINT) AS c FROM invoices),
        t AS (SELECT *, CAST(((2 * 100 * CAST(amount AS HUGEINT) * c + w) // (2 * w)) / 100 AS {_M}) AS freight FROM s)
        SELECT client_id, invoice_id, invoice_total, freight, CAST(amount - sum(freight) OVER (PARTITION BY client_id) AS {_M}) AS residual FROM t""",
    "cost_apportion": f"""WITH {ITEMS_SQL}, s AS (SELECT *, sum(total_cost) OVER (PARTITION BY invoice_id, tariff_code) AS gc, sum(total_cost) OVER (PARTITION BY invoice_id) AS ic FROM items),
        l AS (SELECT invoice_id, CAST(total_cost + CAST(coalesce(CAST(25.5 AS DOUBLE) * total_cost / nullif(gc, 0), 0) AS DECIMAL(18,6)) + CAST(coalesce(CAST(invoice_id % 50 AS DOUBLE) * total_cost / nullif(ic, 0), 0) AS DECIMAL(18,6)) AS DECIMAL(18,6)) AS landed FROM s)
        SELECT invoice_id, CAST(sum(CAST(round(CAST(landed * CAST(1.5 AS DECIMAL(6,2)) AS DECIMAL(24,8)), 2) AS {_M})) AS {_M}) AS price, count(*) AS n FROM l GROUP BY 1""",
    "rule_extraction": """WITH p AS (SELECT row_number() OVER () AS i, p_brand, p_type, p_name || ' ' || lower(p_type) || ' ' || p_size AS text FROM part), g AS (SELECT p_brand, p_type, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 3),
        w AS (SELECT DISTINCT i, p_brand, p_type, unnest(string_split(text, ' ')) AS word FROM p), c AS (SELECT p_brand, p_type, word, count(*) AS has FROM w WHERE length(word) >= 3 AND NOT regexp_matches(word, '^[0-9]+$') GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY has DESC, word) AS r FROM c JOIN g USING (p_brand, p_type) WHERE has >= 0.6 * n)
        SELECT p_brand, p_type, any_value(n) AS n, string_agg(word, ' ' ORDER BY r) AS words FROM k WHERE r <= 5 GROUP BY 1, 2""",
    "shipment_summary": f"""WITH {_SHIP}, s AS (SELECT shipment_id, count(*) AS items, count(officer_code) AS assessed, count(*) FILTER (officer_code = pipeline_code) AS agree FROM ship GROUP BY 1)
        SELECT o_orderkey AS shipment_id, coalesce(items, 0) AS items, coalesce(assessed, 0) AS assessed, coalesce(agree, 0) AS agree, CAST(round(CAST(100 * agree / nullif(assessed, 0) AS DECIMAL(18,6)), 1) AS DOUBLE) AS accuracy_pct FROM orders LEFT JOIN s ON shipment_id = o_orderkey""",
    "source_accuracy": f"""WITH {_SHIP} SELECT source, count(*) AS n, CAST(round(CAST(100 * count(*) FILTER (officer_code = pipeline_code) / count(*) AS DECIMAL(18,6)), 1) AS DOUBLE) AS accuracy_pct,
        CAST(round(CAST(CAST(sum(CAST(confidence AS DECIMAL(10,6))) AS DOUBLE) / count(*) AS DECIMAL(18,6)), 3) AS DOUBLE) AS avg_confidence FROM ship WHERE officer_code IS NOT NULL GROUP BY 1""",
    "tax_pivot": f"""SELECT l_orderkey AS item_id, {", ".join(f"CAST(sum(CAST(l_extendedprice AS {_M})) FILTER (l_linenumber % 4 = {i}) AS {_M}) AS {n}" for i, n in enumerate(("CET", "CSC", "VAT")))} FROM lineitem GROUP BY 1""",
    "closest_charge": f"""WITH c AS (SELECT l_orderkey AS k, CAST(l_extendedprice AS {_M}) AS charge, abs(CAST(l_extendedprice AS {_M}) - CAST(o_totalprice AS {_M})) AS gap FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT k, charge, gap FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gap, charge) AS r FROM c) WHERE r = 1""",
    "total_salvage": f"""{_BASE}, {_REC} SELECT invoice_id, invoice_id % 4 = 0 AS uncertain, CAST(CASE WHEN invoice_id % 4 > 0 THEN invoice_total WHEN invoice_id % 8 = 0 THEN 100 + adjustments ELSE items_total + adjustments END AS {_M}) AS invoice_total FROM rec""",
    "first_group_only": f"WITH {ITEMS_SQL}, {SEQ_SQL}, {INVOICES_SQL} SELECT invoice_id, count(*) FILTER (seq = 1) AS filled, max(freight) AS freight, count(*) AS n FROM numbered JOIN invoices USING (invoice_id) GROUP BY 1",
}

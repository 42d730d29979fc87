"""Queries of items divided among declarations. Every order has one to three made-up declarations, whose duties and charges follow from its key (k)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.operators import splitting as S
from tradeloom.sources.tables import ITEMS_SQL, SEQ_SQL, invoice_items, invoices, table, with_seq

#: Expressions that both engines read: the number of declarations, a declaration's weight, and what it states.
_N = "1 + k % 3"
_RATE = "CASE part_id % 3 WHEN 1 THEN 0.05 WHEN 2 THEN 0.35 END"
_DUTY = "CASE WHEN k % 10 = 0 THEN CAST(0.5 AS DECIMAL(18,2)) ELSE CAST(whole * (d + 1) * 0.44 / n AS DECIMAL(18,2)) END"
_STATED = {
    "local": f"CASE WHEN (k + d) % 5 > 0 THEN concat('$', {_DUTY}) ELSE 'n/a' END",
    "foreign_": f"CASE WHEN (k + d) % 7 = 0 THEN CAST({_DUTY} AS STRING) END",
    "hand": f"CASE WHEN (k + d) % 15 = 0 THEN concat({_DUTY}, ' ') END",
}
_FREIGHT = "(k + d) % 9"
_CHARGES = "CASE WHEN k % 3 > 0 AND k % 4 < 2 THEN {make}(CAST(whole * n * 0.3 AS DECIMAL(18,2)), CAST(whole * 0.4 AS DECIMAL(18,2))) WHEN k % 4 = 2 THEN {make}(CAST(whole * 0.2 AS DECIMAL(18,2)), CAST(whole * 0.5 AS DECIMAL(18,2)), CAST(whole * 0.3 AS DECIMAL(18,2))) END"


def _inputs(spark, d):
    items = with_seq(invoice_items(spark, d)).withColumn("rate", F.expr(_RATE))
    whole = items.groupBy("invoice_id").agg(F.sum("total_cost").alias("whole"))
    base = whole.withColumn("k", F.col("invoice_id")).withColumn("n", F.expr(_N))
    stated = base.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))).select("invoice_id", F.col("d").alias("declaration"), *[F.expr(e).alias(c) for c, e in _STATED.items()], F.expr(_FREIGHT).alias("freight"), F.lit(None).alias("insurance"))
    stated = stated.withColumn("duties", S.duty_candidates(F.col("local"), F.col("foreign_"), F.lit(None), F.col("hand")))
    charges = base.select("invoice_id", F.coalesce(F.expr(_CHARGES.format(make="array")), F.array().cast("array<decimal(18,2)>")).alias("charges"))
    inv = invoices(spark, d).select("invoice_id", "tax", "invoice_total").join(charges, "invoice_id")
    return items, S.targets_from_duties(stated, items), inv


def item_split(spark, d):
    items, declarations, inv = _inputs(spark, d)
    return S.items_split(items, declarations, inv).select("invoice_id", "declaration", "seq", "quantity", "total_cost", "strategy")


def split_totals(spark, d):
    items, declarations, inv = _inputs(spark, d)
    return S.declaration_totals(S.items_split(items, declarations, inv), declarations, inv)


QUERIES = {"item_split": item_split, "item_split_totals": split_totals}

_X = "2.7169::DOUBLE"
_SPLIT_SQL = f"""WITH {ITEMS_SQL}, {SEQ_SQL},
  t AS (SELECT invoice_id AS k, sum(total_cost) AS whole, list(CAST(total_cost AS DOUBLE) ORDER BY seq) AS costs, CAST(sum(CAST(floor(quantity) AS BIGINT)) AS BIGINT) AS units,
        CAST(sum(total_cost * coalesce(CAST({_RATE} AS DECIMAL(10,6)), 0.2)) AS DOUBLE) / CAST(sum(total_cost) AS DOUBLE) AS rate FROM (SELECT *, invoice_id AS k FROM numbered) GROUP BY 1),
  b AS (SELECT *, {_N} AS n, coalesce({_CHARGES.format(make="list_value")}, []) AS charges FROM t WHERE {_N} > 1),
  st AS (SELECT *, {", ".join(f"{e} AS {c}" for c, e in _STATED.items())}, {_FREIGHT} AS freight FROM (SELECT *, unnest(range(n)) AS d FROM b)),
  du AS (SELECT *, list_filter([TRY_CAST(replace(local, '$', '') AS DOUBLE), round(CAST(CAST(foreign_ AS DECIMAL(18,2)) * 2.7169 AS DECIMAL(28,8)), 2)::DOUBLE, round(CAST(CAST(trim(hand) AS DECIMAL(18,2)) * 2.7169 AS DECIMAL(28,8)), 2)::DOUBLE], lambda x: x > 0) AS duties,
        1.15::DOUBLE * rate + {0.06 * 1.15 + 0.15!r}::DOUBLE AS composite FROM st),
  ta AS (SELECT *, coalesce(list_filter(list_transform(duties, lambda x: x / composite / {_X} - freight), lambda x: x > 0)[1], duties[1] / {_X}) AS target FROM du),
  i AS (SELECT k, any_value(n) AS n, any_value(costs) AS costs, any_value(units) AS units, any_value(charges) AS charges, list(target ORDER BY d) AS targets, 1 + CASE WHEN any_value(o_totalprice) > 0 THEN CAST(k % 11 AS DOUBLE) / CAST(CAST(any_value(o_totalprice) AS DECIMAL(18,2)) AS DOUBLE) ELSE 0.07 END AS taxed
        FROM ta JOIN orders ON o_orderkey = k GROUP BY k),
  u AS (SELECT *, list_transform(charges, lambda c: CAST(c AS DOUBLE) / taxed) AS untaxed, len(list_filter(targets, lambda x: x IS NOT NULL)) AS known FROM i),
  perms AS (SELECT 2 AS n, p, o FROM (SELECT unnest([[1, 2], [2, 1]]) AS o, generate_subscripts([[1, 2], [2, 1]], 1) AS p) UNION ALL
        SELECT 3, p, o FROM (SELECT unnest([[1, 2, 3], [1, 3, 2], [2, 1, 3], [2, 3, 1], [3, 1, 2], [3, 2, 1]]) AS o, generate_subscripts([1, 2, 3, 4, 5, 6], 1) AS p)),
  po AS (SELECT u.*, p, list_transform(o, lambda j: untaxed[j]) AS wanted FROM u JOIN perms USING (n) WHERE len(charges) = n),
  fit AS (SELECT * FROM po WHERE known < n QUALIFY row_number() OVER (PARTITION BY k ORDER BY list_sum(list_prepend(0.0::DOUBLE, list_transform(range(1, n + 1), lambda j: CASE WHEN targets[j] IS NULL THEN 0 ELSE abs(wanted[j] - targets[j]) END))), p) = 1),
  trials AS (SELECT k, n, costs, 'duty' AS kind, 0 AS p, targets FROM u WHERE known = n UNION ALL SELECT k, n, costs, 'charges', p, wanted FROM po UNION ALL
        SELECT k, n, costs, 'mixed', 0, list_transform(range(1, n + 1), lambda j: coalesce(targets[j], wanted[j])) FROM fit),
  ways AS (SELECT k, n, costs, code, list_transform(range(0, len(costs)), lambda i: CASE WHEN n = 2 THEN 1 - (code // CAST(power(2, i) AS BIGINT)) % 2 ELSE (code // CAST(power(3, i) AS BIGINT)) % 3 END) AS way
        FROM (SELECT k, n, costs, unnest(range(CAST(power(n, len(costs)) AS BIGINT))) AS code FROM u WHERE len(costs) >= n)),
  full_ways AS (SELECT k, code, way, list_transform(range(0, n), lambda d: list_reduce(list_prepend(0.0::DOUBLE, list_transform(costs, lambda c, i: CASE WHEN way[i] = d THEN c ELSE 0.0::DOUBLE END)), lambda x, y: x + y)) AS sums FROM ways WHERE len(list_distinct(way)) = n),
  scores AS (SELECT r.k, kind, p, targets, code, way, list_max(list_transform(range(1, n + 1), lambda d: abs(sums[d] - targets[d]) / greatest(targets[d], 1e-9::DOUBLE))) AS worst, list_reduce(list_transform(range(1, n + 1), lambda d: abs(sums[d] - targets[d])), lambda x, y: x + y) AS gaps
        FROM trials r JOIN full_ways w ON w.k = r.k),
  best_ways AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY k, kind, p ORDER BY worst, gaps, code) = 1),
  best AS (SELECT * FROM best_ways QUALIFY row_number() OVER (PARTITION BY k, kind ORDER BY round(worst, 9), round(gaps, 6), p) = 1),
  won AS (SELECT * FROM best WHERE list_min(targets) >= 1 AND worst <= 5 QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE kind WHEN 'duty' THEN 1 WHEN 'charges' THEN 2 ELSE 3 END) = 1),
  rest AS (SELECT u.k, n, len(costs) AS lines, units FROM u ANTI JOIN won ON won.k = u.k),
  dealt AS (SELECT r.k, n, q.*, (row_number() OVER (PARTITION BY r.k ORDER BY seq, x) - 1) % n AS d FROM (SELECT * FROM rest WHERE lines < n AND units >= n) r JOIN (SELECT *, unnest(range(CAST(floor(quantity) AS BIGINT))) AS x FROM numbered) q ON q.invoice_id = r.k),
  assigned AS (
    SELECT k AS invoice_id, CAST(way[seq] AS INT) AS declaration, CAST(seq AS INT) AS seq, CAST(quantity AS DOUBLE) AS quantity, CAST(total_cost AS DOUBLE) AS total_cost, kind AS strategy FROM won JOIN numbered ON invoice_id = k
    UNION ALL SELECT k, CAST(d AS INT), CAST(min(seq) AS INT), CAST(count(*) AS DOUBLE), CAST(sum(CAST(round(unit_cost, 2) AS DECIMAL(18,2))) AS DOUBLE), 'quantity' FROM dealt GROUP BY k, d, description, tariff_code
    UNION ALL SELECT k, CAST((seq - 1) % n AS INT), CAST(seq AS INT), CAST(quantity AS DOUBLE), CAST(total_cost AS DOUBLE), 'turn' FROM rest JOIN numbered ON invoice_id = k WHERE NOT (lines < n AND units >= n))"""

SQL = {
    "item_split": f"{_SPLIT_SQL} SELECT * FROM assigned",
    "item_split_totals": f"""{_SPLIT_SQL},
  mine AS (SELECT invoice_id, declaration, count(*) AS items, sum(CAST(total_cost AS DECIMAL(18,2))) AS total FROM assigned GROUP BY 1, 2),
  every AS (SELECT u.k AS invoice_id, n, charges, CAST(d AS INT) AS declaration, coalesce(items, 0) AS items, coalesce(total, 0) AS total, sum(coalesce(total, 0)) OVER (PARTITION BY u.k) AS whole FROM (SELECT *, unnest(range(n)) AS d FROM u) u LEFT JOIN mine ON invoice_id = k AND declaration = d),
  shares AS (SELECT *, CAST(total AS DOUBLE) / CAST(whole AS DOUBLE) AS part FROM every)
  SELECT invoice_id, declaration, items, CAST(total AS DECIMAL(18,2)) AS items_total, round(CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) * CASE WHEN items > 0 THEN part ELSE 1.0::DOUBLE / n END AS DECIMAL(28,6)), 2) AS invoice_share,
    CASE WHEN len(charges) = n THEN list_min(list_transform(charges, lambda c: abs(CAST(c AS DOUBLE) - (CAST(total AS DOUBLE) + CAST(invoice_id % 11 AS DOUBLE) * part)))) <= 2 END AS charge_met FROM shares JOIN orders ON o_orderkey = invoice_id""",
}

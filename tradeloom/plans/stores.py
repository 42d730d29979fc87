"""Queries of merged readings, heads of special documents, and JSON stores moved into a table. Texts and stores are made from orders and parts (k)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.operators import heads as H
from tradeloom.operators import migration as G
from tradeloom.operators import supertext as T
from tradeloom.plans.order import TRUST, _readings
from tradeloom.sources.tables import table


def super_text(spark, d):
    """Three readings of every conversation turn, merged."""
    return T.super_text(_readings(spark, d), TRUST)


#: Expressions that both engines read.
_RATE = "0.14 + (k % 50) / 1000.0"
_CONVERTER = """CASE k % 6 WHEN 0 THEN concat('xe\nT ony ~ ', format_string('%.4f', CAST({r} AS DOUBLE)), ' USO\nMar 15, 2025, 13:52 UTC now') WHEN 1 THEN concat('1 USD = ', format_string('%.4f', CAST(7.1 AS DOUBLE)), ' CNY but i EUR: 1.085', k % 10, ' USD 2025-03-15 13:52')
  WHEN 2 THEN concat('100.00 Chinose Yuan Renminbi\n', CAST(14 + k % 5 AS STRING), '.25 USDollars\n1,000.00 Chinese Yuan\nis about\n', CAST(150 + k % 7 AS STRING), '.50 US Dollars\n10.00 Chinese Yuan\n9.00 US Dollars')
  WHEN 3 THEN concat('1 GBP = 200000.123 USD') WHEN 4 THEN 'no rate 1 CNY = 0.14 EUR' END"""


def rates(spark, d):
    k = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    r = k.select(F.col("k").alias("doc_id"), H.conversion_rate(F.expr(_CONVERTER.replace("{r}", _RATE))).alias("r"))
    return r.select("doc_id", "r.source", "r.target", "r.rate", "r.samples", "r.date")


_MANIFEST = r"""concat(CASE WHEN k % 7 > 0 THEN 'ASYCUDA World\n' ELSE 'Other\n' END, CASE k % 3 WHEN 0 THEN 'Man Reg Number: 2025 5' WHEN 1 THEN 'Man Reg Number 2024/' ELSE 'Reg ' END, k % 90, '\nWayBill ', CASE k % 5 WHEN 0 THEN 'No and' ELSE concat('HAWB', k) END, '\n',
  CASE WHEN k % 11 = 0 THEN concat('Bill of Lading Number\n\n', 'tscw', k, '\n') ELSE '' END, 'Customs Office: ST GEORGES\nNo and Type of ', CASE WHEN k % 13 = 0 THEN '#* ' ELSE '' END, k % 40 + 1, CASE WHEN k % 13 = 0 THEN '\n' ELSE ' ' END, 'Package\n',
  CASE k % 4 WHEN 0 THEN concat('Consignee: JOHN SMITH (FREIGHT ', k % 30, '.50 US)\n') WHEN 1 THEN 'Consignee: MARY JONES\n' WHEN 2 THEN 'Consignee: SAME AS CONSIGNEE\nHILLS AND VALLEY,\nNotify: x\nMain Street,\nSt 2\nLine Number 1\n' ELSE 'Shipper\n' END,
  'Gross Mass: 1,', k % 900 + 100, '.5 Freight ', k % 50, '.00\nVoyage W', k, '\nVessel Name: WINDING BAY \n')"""


def manifests(spark, d):
    k = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = k.repartition(parts, "k").select(F.col("k").alias("doc_id"), F.expr(_MANIFEST).alias("text"))
    return H.manifests(texts).select("doc_id", "m.*")


def _stores(spark, d):
    """Assessed codes and looked-up ones as JSON documents of a hundred parts each, and a table that has some of the former already."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_brand").withColumn("name", F.lower(F.concat_ws(" ", "p_name", F.lit("part"), F.concat(F.lit("x"), "k"))))
    k = F.col("k")
    code = F.lpad((k % 40 * 2300017 + 1010000).cast("string"), 8, "0")
    entry = F.struct(code.alias("code"), F.when(k % 3 == 0, F.col("p_brand")).alias("category"), (k % 100 / 100).cast("double").alias("confidence"), k.alias("count"), (k * 2).alias("total"), F.when(k % 4 == 0, F.array(F.lit("a"), F.lit("b"))).alias("sources"))
    pair = lambda key, value: F.concat(F.to_json(F.array(key)).substr(F.lit(2), F.length(F.to_json(F.array(key))) - 2), F.lit(":"), value)
    group = (k / 100).cast("int").alias("g")
    assessed = p.filter("k % 2 = 0").groupBy(group).agg(F.array_join(F.collect_list(pair(F.col("name"), F.to_json(entry))), ",").alias("body"))
    assessed = assessed.select(F.when(F.col("g") % 2 == 0, F.concat(F.lit('{"entries":{"_metadata":{"code":"1"},'), "body", F.lit("}}"))).otherwise(F.concat(F.lit("{"), "body", F.lit("}"))).alias("json"))
    other = F.when(k % 6 == 0, F.concat(F.lit("9999"), F.substring(code, 5, 4))).when(k % 10 == 5, F.lit("")).otherwise(code)
    found = F.struct(F.upper("name").alias("original_description"), other.alias("code"), F.when(k % 5 == 0, F.lit("llm")).alias("source"), F.when(k % 7 == 0, F.lit(0.9)).alias("confidence"), (k % 8 == 0).alias("verified_against_assessed"))
    key = F.when(k % 9 == 0, F.concat(F.lit("__asycuda_"), k)).otherwise(F.col("name"))
    cache = p.groupBy(group).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(pair(key, F.to_json(found))), ","), F.lit("}")).alias("json"))
    have = G.assessed_rows(assessed).filter("assessed_count % 10 = 0")
    return have, assessed, cache


def migration(spark, d):
    """The table after the stores were moved into it twice."""
    have, assessed, cache = _stores(spark, d)
    once = G.migrated(have, assessed, cache)
    return G.migrated(once, assessed, cache).select("description_norm", "tariff_code", "category", "source", "confidence", "unverified", "assessed_total", "assessed_sources", "notes")


def migrated_lookup(spark, d):
    return G.lookup(G.migrated(*_stores(spark, d))).select("description_norm", "tariff_code", "confidence", "source")


QUERIES = {"super_text": super_text, "conversion_rates": rates, "manifest_fields": manifests, "json_migration": migration, "migrated_lookup": migrated_lookup}

_MOVED = """WITH p AS (SELECT p_partkey AS k, lower(p_name || ' part x' || p_partkey) AS name, p_brand, lpad(CAST((p_partkey % 40) * 2300017 + 1010000 AS VARCHAR), 8, '0') AS code FROM part),
  a AS (SELECT k, name AS description_norm, code AS tariff_code, CASE WHEN k % 3 = 0 THEN p_brand ELSE '' END AS category, 'assessed_exact' AS source, k % 100 / 100.0::DOUBLE AS confidence, 0 AS unverified, k * 2 AS assessed_total, CASE WHEN k % 4 = 0 THEN '["a","b"]' END AS assessed_sources, 'count=' || k || '/' || k * 2 AS notes FROM p WHERE k % 2 = 0),
  c AS (SELECT k, trim(regexp_replace(regexp_replace(name, '(^| )[^ ]( |$)', ' ', 'g'), ' +', ' ', 'g')) AS description_norm, CASE WHEN k % 6 = 0 THEN '9999' || code[5:] WHEN k % 10 = 5 THEN '' ELSE code END AS tariff_code, '' AS category, CASE WHEN k % 5 = 0 THEN 'llm' ELSE 'web_search' END AS source,
        CASE WHEN k % 7 = 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE WHEN k % 8 = 0 THEN 0 ELSE 1 END AS unverified, NULL AS assessed_total, NULL AS assessed_sources, '' AS notes FROM p WHERE k % 9 > 0),
  kept AS (SELECT c.* FROM c LEFT JOIN a USING (description_norm) WHERE c.tariff_code <> '' AND (a.tariff_code IS NULL OR left(a.tariff_code, 4) = left(c.tariff_code, 4))),
  moved AS (SELECT * FROM a UNION ALL SELECT * FROM kept)"""
SQL = {
    "conversion_rates": """WITH o AS (SELECT o_orderkey AS k FROM orders), q AS (SELECT k, list_sort(list_filter([(14.25 + k % 5)::DOUBLE / 100.0::DOUBLE, (150.5 + k % 7)::DOUBLE / 1000.0::DOUBLE], lambda x: x > 0)) AS qs FROM o)
        SELECT k AS doc_id, CASE k % 6 WHEN 0 THEN 'CNY' WHEN 1 THEN 'EUR' WHEN 2 THEN 'CNY' END AS source, CASE WHEN k % 6 < 3 THEN 'USD' END AS target,
          CASE k % 6 WHEN 0 THEN CAST(printf('%.4f', CAST(0.14 + (k % 50) / 1000.0 AS DOUBLE)) AS DOUBLE) WHEN 1 THEN CAST('1.085' || k % 10 AS DOUBLE) WHEN 2 THEN round(qs[2], 8) END AS rate, CASE k % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS samples,
          CASE k % 6 WHEN 0 THEN 'Mar 15, 2025, 13:52 UTC' WHEN 1 THEN '2025-03-15 13:52' END AS date FROM q""",
    "manifest_fields": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 7 > 0 AS y FROM orders)
        SELECT k AS doc_id, CASE WHEN y THEN CASE WHEN k % 11 = 0 THEN 'TSCW' || k WHEN k % 5 > 0 THEN 'HAWB' || k END END AS waybill, CASE WHEN y THEN CASE k % 3 WHEN 0 THEN '2025 5' || k % 90 WHEN 1 THEN '2024/' || k % 90 END END AS man_reg,
          CASE WHEN y THEN CASE k % 4 WHEN 0 THEN 'JOHN SMITH' WHEN 1 THEN 'MARY JONES' WHEN 2 THEN 'HILLS AND VALLEY' END END AS consignee_name, CASE WHEN y AND k % 4 = 2 THEN 'Main Street, St 2' END AS consignee_address,
          CASE WHEN y THEN CAST(k % 40 + 1 AS VARCHAR) END AS packages, CASE WHEN y THEN 'Package' END AS package_type, CASE WHEN y THEN '1' || (k % 900 + 100) || '.5' END AS weight, CASE WHEN y THEN CASE WHEN k % 4 = 0 THEN k % 30 || '.50' ELSE k % 50 || '.00' END END AS freight,
          CASE WHEN y THEN 'ST GEORGES' END AS office, CASE WHEN y THEN 'W' || k END AS voyage, CASE WHEN y THEN 'WINDING BAY' END AS vessel FROM o""",
    "json_migration": f"{_MOVED} SELECT description_norm, tariff_code, category, source, confidence, unverified, assessed_total, assessed_sources, notes FROM moved",
    "migrated_lookup": f"{_MOVED} SELECT description_norm, tariff_code, confidence, source FROM moved QUALIFY row_number() OVER (PARTITION BY description_norm ORDER BY confidence DESC, tariff_code DESC, source DESC) = 1",
}

"""Queries of lookups, extraction, repairs and states."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.operators import lookup as L
from tradeloom.sources.tables import ITEMS_SQL, SEQ_SQL, invoice_items, table, with_seq

ALIASES = [(1, "11112222", "bolt", True), (2, "33334444", "red", True), (3, "55556666", "blue", False), (4, "77778888", "anvil", True), (5, "11112222", "screw", True)]


def _aliases(spark):
    return spark.createDataFrame(ALIASES, "id int, code string, alias string, enabled boolean")


def sku_classify(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("sku"), F.col("p_name").alias("description"))
    a = table(spark, d, "lineitem").filter("l_partkey % 3 = 0").select(F.col("l_partkey").alias("sku"), F.lpad(F.col("l_suppkey").cast("string"), 8, "0").alias("code"), F.col("l_shipdate").alias("created_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return L.sku_classified(p, a.groupBy("sku", "created_at", "id").agg(F.max("code").alias("code")), _aliases(spark))


def exact_lookup(spark, d):
    codes = spark.createDataFrame([("11112222",), ("33334444",), ("55556666",), ("99990000",)], "code string")
    return L.with_aliases(codes, _aliases(spark))


def office(spark, d):
    dim = spark.createDataFrame([("nation_3", "N3"), ("nation_7", "N7"), ("region_1", "R1")], "place string, office string")
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.concat(F.lit(" Region_"), F.col("n_regionkey")).alias("area"))
    return L.first_known(n, ["n_name", "area"], dim, "place", "office", "HQ").select("n_nationkey", "office")


def supplier(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("name"), F.concat(F.lit("S"), F.col("s_suppkey")).alias("code"))
    k = F.col("s_suppkey")
    names = table(spark, d, "supplier").select(F.when(k % 4 == 0, F.concat(F.lit("s"), k)).when(k % 4 == 1, F.upper("s_name")).when(k % 4 == 2, F.concat("s_name", F.lit(" Ltd"))).otherwise(F.concat(F.lit("nobody "), k)).alias("name"))
    return L.supplier_found(names, s)


def bundle_inherit(spark, d):
    items = table(spark, d, "part").select(F.concat("p_brand", F.lit("-"), F.col("p_size")).alias("sku"), F.col("p_partkey").alias("seq"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("code"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("bundle_id"), F.array(F.concat(F.lit("Brand#"), F.col("s_suppkey") % 40, F.lit("-"), F.col("s_nationkey")), F.concat(F.lit("Brand#"), F.col("s_nationkey"), F.lit("*"))).alias("members"))
    return L.bundles_inherit(b, items)


def recap(spark, d):
    o = table(spark, d, "orders")
    base = F.concat(F.lit("INV-2024-"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"))
    r = o.filter("o_orderkey % 3 > 0").select(F.when(F.col("o_orderkey") % 3 == 1, base).otherwise(F.concat(base, F.lit("-A"))).alias("ref"))
    i = o.filter("o_orderkey % 5 > 0").select(F.when(F.col("o_orderkey") % 7 == 0, F.concat(base, F.lit("-B"))).otherwise(base).alias("invoice_ref"))
    return L.recap_matched(r, i)


def cache(spark, d):
    c = spark.createDataFrame([("hot", "c1"), ("hot gear", "c2"), ("large rod extra", "c3")], "key string, code string")
    return L.cached(table(spark, d, "part").select(F.col("p_name").alias("term")).distinct(), c)


def variants(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("variant_id"), (F.col("turn") % 2).alias("priority"), "text")
    return L.variant_picked(t, least_chars=20)


def fields(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", L.field(F.col("text"), [r"token = \"([0-9a-f]+)\"", r"([A-Za-z0-9.]+@mail\d\.example\.com)"], "none").alias("field"), L.field_sum(F.col("text"), [r"\b(\d{1,3}\.\d{2})\b"]).alias("amount"))


def classes(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.element_at(F.array(*map(F.lit, ("Invoice", "Freight invoice", "RECAP of total", "Manifest", "Packing List", "B/L no 4", "Declaration", "")), ), (F.col("p_partkey") % 8 + 1).cast("int"))).alias("t"))
    return p.select("p_partkey", L.content_class(F.col("t")).alias("content"))


def charge_list(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("paid $"), F.format_number(F.abs("c_acctbal"), 2), F.lit(" and $ 0.00, $"), F.format_number(F.abs("c_acctbal") + 1, 2)).alias("t"))
    return c.select("c_custkey", F.posexplode(L.charges(F.col("t"))).alias("place", "amount"))


def arithmetic(spark, d):
    i = with_seq(invoice_items(spark, d)).select("invoice_id", "seq", (F.col("part_id") % 9 + 1).alias("base"))
    q, u = (F.col("seq") + 1), F.col("base")
    made = i.select("invoice_id", "seq", F.when(F.col("seq") % 3 == 0, q + 5).otherwise(q).cast("decimal(18,4)").alias("quantity"), F.when(F.col("seq") % 3 == 1, u + F.lit(0.1)).otherwise(u).cast("decimal(18,4)").alias("unit_cost"), (q * u).cast("decimal(18,2)").alias("total_cost"))
    return L.arithmetic_fixed(made)


def digits(spark, d):
    o = table(spark, d, "orders")
    m = "decimal(18,2)"
    s, k = F.col("o_totalprice").cast(m), F.col("o_orderkey")
    tax = (k % 90 + 10).cast(m)
    rows = o.select(k.alias("id"), s.alias("subtotal"), F.when(k % 4 == 1, tax + 3).when(k % 4 == 3, tax + F.lit(123.45).cast(m)).otherwise(tax).cast(m).alias("tax"), F.when(k % 4 == 2, s + tax + 1000).otherwise(s + tax).cast(m).alias("total"))
    out = L.digit_fixed(rows)
    return out.select("id", ((F.col("subtotal") + F.col("tax")) == F.col("total")).alias("balanced"), (F.col("fixed").isNotNull()).alias("changed")).groupBy("balanced", "changed").agg(F.count("*").alias("n"))


def convert(spark, d):
    i = with_seq(invoice_items(spark, d)).select("invoice_id", "seq", F.element_at(F.array(*map(F.lit, ("USD", "XCD", "GBP"))), (F.col("supplier_id") % 3 + 1).cast("int")).alias("currency"), "unit_cost")
    rates = spark.createDataFrame([("USD", "2.7169"), ("GBP", "3.4512")], "currency string, rate string")
    return L.converted(i, rates, F.col("invoice_id") % 4).groupBy("invoice_id").agg(F.sum("unit_cost").cast("decimal(18,4)").alias("cost"))


def statuses(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 5).alias("retry_count"))
    return L.resumable(L.latest_status(e, "user_id", ["event_id"], ["status", "retry_count"]), ["click", "error", "purchase"])


def block(spark, d):
    return L.totals_block(invoice_items(spark, d))


def headers(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "signup").alias("is_header"), F.col("value").cast("decimal(18,2)").alias("amount"))
    return L.headers_recomputed(e, "user_id", "event_id")


def disagree(spark, d):
    c = table(spark, d, "customer")
    groups = c.select("c_custkey", F.lower("c_name").alias("name"))
    bills = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(" & sons"))).when(F.col("c_custkey") % 3 == 1, F.lit("Customer#")).otherwise("Someone").alias("consignee"))
    return L.names_disagree(groups, bills, "c_custkey")


QUERIES = {
    "sku_classification": sku_classify, "tariff_lookup_exact": exact_lookup, "office_lookup": office, "supplier_lookup": supplier, "bundle_inheritance": bundle_inherit, "recap_cross_reference": recap,
    "lookup_cache": cache, "ocr_variant_pick": variants, "field_extraction": fields, "content_class": classes, "cc_charges": charge_list, "item_arithmetic_fix": arithmetic, "metadata_arithmetic_fix": digits,
    "currency_conversion": convert, "email_status": statuses, "totals_block": block, "group_header_recompute": headers, "consignee_disagreement": disagree,
}

_AL = "al AS (SELECT * FROM (VALUES (1, '11112222', 'bolt', true), (2, '33334444', 'red', true), (3, '55556666', 'blue', false), (4, '77778888', 'anvil', true), (5, '11112222', 'screw', true)) t(id, code, alias, enabled))"
SQL = {
    "sku_classification": f"""WITH {_AL}, a AS (SELECT l_partkey AS sku, l_shipdate, l_orderkey * 10 + l_linenumber AS id, max(lpad(CAST(l_suppkey AS VARCHAR), 8, '0')) AS code FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY ALL),
        b AS (SELECT sku, code FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY l_shipdate DESC, id DESC) AS r FROM a) WHERE r = 1),
        c AS (SELECT p_partkey AS sku, p_name AS description, (SELECT max_by(code, id) FROM al WHERE enabled AND contains(p_name, alias)) AS ac FROM part)
        SELECT sku, description, coalesce(code, ac) AS code, CASE WHEN code IS NOT NULL THEN 'assessed' WHEN ac IS NOT NULL THEN 'alias' END AS source FROM c LEFT JOIN b USING (sku)""",
    "tariff_lookup_exact": f"WITH {_AL}, c AS (SELECT * FROM (VALUES ('11112222'), ('33334444'), ('55556666'), ('99990000')) t(code)) SELECT code, coalesce(string_agg(alias, ', ' ORDER BY alias), '') AS aliases FROM c LEFT JOIN (SELECT * FROM al WHERE enabled) USING (code) GROUP BY 1",
    "office_lookup": "SELECT n_nationkey, CASE WHEN n_name IN ('NATION_3', 'NATION_7') THEN 'N' || substr(n_name, 8) WHEN n_regionkey = 1 THEN 'R1' ELSE 'HQ' END AS office FROM nation",
    "supplier_lookup": """SELECT CASE s_suppkey % 4 WHEN 0 THEN 's' || s_suppkey WHEN 1 THEN upper(s_name) ELSE s_name || ' Ltd' END AS name, s_suppkey AS supplier_id, CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS tier FROM supplier WHERE s_suppkey % 4 < 3""",
    "bundle_inheritance": """WITH i AS (SELECT p_brand || '-' || p_size AS sku, p_partkey AS seq, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code FROM part),
        m AS (SELECT s_suppkey AS bundle_id, 0 AS place, 'Brand#' || s_suppkey % 40 || '-' || s_nationkey AS m FROM supplier UNION ALL SELECT s_suppkey, 1, 'Brand#' || s_nationkey FROM supplier),
        h AS (SELECT bundle_id, code, row_number() OVER (PARTITION BY bundle_id ORDER BY place, seq) AS r FROM m JOIN i ON CASE WHEN place = 0 THEN sku = m ELSE starts_with(sku, m) END) SELECT bundle_id, code FROM h WHERE r = 1""",
    "recap_cross_reference": """WITH o AS (SELECT o_orderkey AS k, 'INV-2024-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS b FROM orders), r AS (SELECT DISTINCT CASE WHEN k % 3 = 1 THEN b ELSE b || '-A' END AS ref FROM o WHERE k % 3 > 0),
        i AS (SELECT DISTINCT CASE WHEN k % 7 = 0 THEN b || '-B' ELSE b END AS invoice_ref FROM o WHERE k % 5 > 0),
        p AS (SELECT ref, invoice_ref, 0 AS way FROM r JOIN i ON ref = invoice_ref UNION ALL SELECT ref, invoice_ref, 1 FROM r JOIN i ON left(ref, 15) = left(invoice_ref, 15)
              UNION ALL SELECT ref, invoice_ref, 2 FROM r JOIN i ON left(ref, 14) = left(invoice_ref, 14) UNION ALL SELECT ref, invoice_ref, 3 FROM r JOIN i ON left(ref, 13) = left(invoice_ref, 13)),
        b AS (SELECT ref, invoice_ref, way FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY way, invoice_ref) AS n FROM p) WHERE n = 1)
        SELECT * FROM b UNION ALL SELECT ref, NULL, NULL FROM r WHERE ref NOT IN (SELECT ref FROM b) UNION ALL SELECT NULL, invoice_ref, NULL FROM i WHERE invoice_ref NOT IN (SELECT invoice_ref FROM b)""",
    "lookup_cache": """WITH c AS (SELECT * FROM (VALUES ('hot', 'c1'), ('hot gear', 'c2'), ('large rod extra', 'c3')) t(key, code)), t AS (SELECT DISTINCT p_name AS term FROM part)
        SELECT term, coalesce((SELECT code FROM c WHERE key = term), (SELECT min_by(code, key) FROM c WHERE contains(term, key) OR contains(key, term))) AS code, CAST(CASE WHEN term IN (SELECT key FROM c) THEN 0.8 ELSE 0.7 END AS DOUBLE) AS confidence
        FROM t WHERE EXISTS (SELECT 1 FROM c WHERE contains(term, key) OR contains(key, term))""",
    "ocr_variant_pick": r"""WITH v AS (SELECT conv_id AS doc_id, turn AS variant_id, turn % 2 AS priority, len(regexp_extract_all(text, '[0-9]+\.[0-9]{2}')) AS prices, length(text) AS chars FROM conversations WHERE length(text) >= 20)
        SELECT doc_id, variant_id, prices, chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, prices DESC, chars DESC, variant_id) AS r FROM v) WHERE r = 1""",
    "field_extraction": r"""SELECT doc_id, coalesce(nullif(trim(regexp_extract(text, 'token = "([0-9a-f]+)"', 1)), ''), nullif(trim(regexp_extract(text, '([A-Za-z0-9.]+@mail[0-9]\.example\.com)', 1)), ''), 'none') AS field,
        CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '\b([0-9]{1,3}\.[0-9]{2})\b', 1), lambda x: CAST(x AS DECIMAL(18,2)))), 0) AS DECIMAL(18,2)) AS amount FROM documents""",
    "content_class": "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'invoice' WHEN 1 THEN 'freight' WHEN 2 THEN 'recap' WHEN 3 THEN 'manifest' WHEN 4 THEN 'packing_list' WHEN 5 THEN 'bill_of_lading' WHEN 6 THEN 'declaration' ELSE 'unknown' END AS content FROM part",
    "cc_charges": """WITH c AS (SELECT c_custkey, abs(CAST(c_acctbal AS DECIMAL(18,2))) AS a FROM customer) SELECT c_custkey, 0 AS place, a AS amount FROM c WHERE a > 0 UNION ALL SELECT c_custkey, CASE WHEN a > 0 THEN 1 ELSE 0 END, CAST(a + 1 AS DECIMAL(18,2)) FROM c""",
    "item_arithmetic_fix": f"""WITH {ITEMS_SQL}, {SEQ_SQL}, b AS (SELECT invoice_id, seq, seq + 1 AS q, part_id % 9 + 1 AS u FROM numbered),
        m AS (SELECT invoice_id, seq, CASE WHEN seq % 3 = 0 THEN q + 5 ELSE q END AS quantity, CASE WHEN seq % 3 = 1 THEN u + 0.1 ELSE u END AS unit_cost, q * u AS t, q, u FROM b),
        h AS (SELECT *, CASE WHEN abs(quantity * unit_cost - t) <= 0.01 THEN 'kept' WHEN seq % 3 = 0 OR (t * 10) % CAST(unit_cost * 10 AS BIGINT) = 0 THEN 'quantity' WHEN abs(CAST(t AS DOUBLE) / quantity - unit_cost) <= 0.25 * unit_cost THEN 'cost' ELSE 'open' END AS how FROM m)
        SELECT invoice_id, seq, CAST(CASE WHEN how = 'quantity' THEN round(CAST(t AS DOUBLE) / unit_cost) ELSE quantity END AS DECIMAL(18,4)) AS quantity, CAST(CASE WHEN how = 'cost' THEN u ELSE unit_cost END AS DECIMAL(18,4)) AS unit_cost, CAST(t AS DECIMAL(18,2)) AS total_cost, how FROM h""",
    "currency_conversion": f"""WITH {ITEMS_SQL}, c AS (SELECT invoice_id, CAST(unit_cost * 10000 AS HUGEINT) AS u, CASE WHEN invoice_id % 4 >= 2 THEN CASE supplier_id % 3 WHEN 0 THEN 2716900 WHEN 2 THEN 3451200 ELSE 1000000 END ELSE 1000000 END AS r FROM items)
        SELECT invoice_id, CAST(sum((2 * u * r + 1000000) // 2000000) / 10000 AS DECIMAL(18,4)) AS cost FROM c GROUP BY 1""",
    "email_status": """WITH s AS (SELECT user_id, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS status, arg_max(event_id % 5, event_id) FILTER (event_id % 3 = 0) AS retry_count, count(*) AS updates FROM events GROUP BY 1)
        SELECT * FROM s WHERE status IN ('click', 'error', 'purchase') AND retry_count < 3""",
    "totals_block": f"WITH {ITEMS_SQL} SELECT invoice_id, tariff_code, CAST(sum(total_cost) AS DECIMAL(18,2)) AS subtotal, count(*) AS n, CASE WHEN grouping(tariff_code) = 1 THEN true END AS verified FROM items GROUP BY GROUPING SETS ((invoice_id, tariff_code), (invoice_id))",
    "group_header_recompute": """WITH h AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS header FROM events)
        SELECT user_id, header, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount, count(*) AS n FROM h WHERE event_type <> 'signup' AND header IS NOT NULL GROUP BY 1, 2""",
    "consignee_disagreement": "SELECT c_custkey FROM customer WHERE c_custkey % 3 = 2",
}

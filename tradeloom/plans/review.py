"""Queries of small checks and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.operators import review as V
from tradeloom.plans.classify import RULES, rules
from tradeloom.sources.tables import ITEMS_SQL, SEQ_SQL, invoice_items, table, tariff_code, with_seq


def _k():
    return F.col("p_partkey")


def _cents(column: str):
    return F.col(column).cast("decimal(18,2)").cast("string")


def rule_query(spark, d):
    """Rules that speak of each word of the parts' types, or whose code has each heading; the rules are made from the parts."""
    p = table(spark, d, "part")
    made = p.select(_k().alias("id"), tariff_code("p_partkey").alias("code"), F.lower("p_type").alias("category"), F.split("p_name", " ").alias("patterns"))
    words = p.select(F.explode(F.split(F.lower("p_type"), " ")).alias("word"), F.lit("all").alias("field")).union(p.select(F.explode(F.split(F.initcap("p_name"), " ")), F.lit("patterns")))
    return V.rules_queried(made, words.union(p.select(F.substring(tariff_code("p_partkey"), 1, 4), F.lit("code"))).union(p.select(F.substring("p_name", 2, 2), F.lit("patterns"))))


def unknown(spark, d):
    p = table(spark, d, "part").select(_k().alias("item_id"), F.col("p_name").alias("description"), F.when(_k() % 3 == 0, "UNKNOWN").when(_k() % 3 == 1, F.lit(None)).otherwise(tariff_code("p_partkey")).alias("code"), (_k() % 5 == 0).alias("needs_review"))
    return V.unknown_items(p)


def disable(spark, d):
    p = table(spark, d, "part").select(_k().cast("string").alias("code"), F.lit(True).alias("enabled"), F.when(_k() % 2 == 0, F.col("p_brand")).alias("notes"))
    off = table(spark, d, "part").filter("p_partkey % 7 = 0").select(_k().cast("string").alias("code"), F.when(_k() % 3 > 0, F.col("p_type")).alias("reason"))
    return V.disabled(p, off)


def learned(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("pattern"))
    known = table(spark, d, "part").filter("p_partkey % 2 = 0").select(_k().alias("id"))
    return V.new_only(li, known)


def doc_type(spark, d):
    made = spark.createDataFrame([(1, ["#000000001", ""], "7400-000"), (2, ["5", "CUSTOMER#0000001"], "4200-000")], "seq int, words array<string>, doc_type string")
    return V.document_types(table(spark, d, "customer").select("c_custkey", "c_name"), made, "c_name", "4000-000")


def carrier(spark, d):
    ref = F.concat(F.element_at(F.array(*map(F.lit, ("TSCW", "HBL-", "MEDU", ""))), (F.col("o_orderkey") % 4 + 1).cast("int")), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", V.matches_in_full(ref, [r"TSCW\d{4,8}", r"MEDU\d+5"]).alias("is_carrier"))


def bogus(spark, d):
    i = with_seq(invoice_items(spark, d))
    text = F.when((F.col("invoice_id") % 6 == 0) & (F.col("seq") <= 3), "Order Total:").otherwise(F.col("description"))
    return V.bogus(i.select("invoice_id", text.alias("description"), F.when((F.col("invoice_id") % 5 == 0) & (F.col("seq") % 2 == 1), F.lit(None)).otherwise(F.col("quantity")).alias("quantity"), "total_cost"), "invoice_id")


def reverse_scan(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), "l_partkey", "l_suppkey").groupBy("doc_id", "page").agg(F.min("l_suppkey").alias("s"))
    e = e.withColumn("position", F.when((F.col("page") == 1) & (F.col("doc_id") % 2 == 0), "footer").when((F.col("page") >= 4) & (F.col("doc_id") % 3 == 0), "header").otherwise("body"))
    return V.reversed_scans(e, "doc_id", "page", "position")


def no_orders(spark, d):
    i = with_seq(invoice_items(spark, d))
    return V.without_orders(i.withColumn("sku", F.when(F.col("seq") % 2 == 0, F.col("sku"))).withColumn("unit_cost", F.when(F.col("seq") % 3 > 0, F.col("unit_cost"))))


def meta(spark, d):
    i = with_seq(invoice_items(spark, d)).withColumn("source", F.when(F.col("seq") % 2 == 0, "rule").otherwise("assessed"))
    return V.provenance(i).select("invoice_id", F.sha2("meta", 256).alias("meta_sha256"))


def corrections(spark, d):
    s = F.col("s_suppkey")
    formula = F.when(s % 4 == 0, F.concat(F.lit("=(T5+U5-W5)+"), _cents("s_acctbal"))).when(s % 4 == 1, F.lit("=(T5+U5)")).when(s % 4 == 2, _cents("s_acctbal")).otherwise(F.lit("=SUM(A1)+x"))
    rest = F.col("s_suppkey").cast("decimal(18,2)")
    return table(spark, d, "supplier").select("s_suppkey", V.correction_term(formula).alias("term"), V.forced(formula, rest).alias("formula"), V.forced(V.forced(formula, rest + 1), rest).alias("again"))


def templates(spark, d):
    t = F.element_at(F.array(*map(F.lit, ("${name}", "    ${name}", "USD", "${other}", "x ${other}"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", V.resolved(t, F.create_map(F.lit("name"), F.col("s_name"))).alias("value"))


def charges(spark, d):
    o = table(spark, d, "supplier").select(F.col("s_suppkey").alias("bill_id"), F.format_string("%.2f", F.abs("s_acctbal")).alias("m"))
    made = [
        F.concat(F.lit("OCEAN FREIGHT - LCL   "), "m"), F.lit("no amount here"), F.concat(F.lit(" LANDING  1,"), F.lit("298.50 ")), F.concat(F.lit("USD "), "m", F.lit(" paid")), F.lit("TOTAL USD"), F.concat("m", F.lit(" x")), F.lit("LANDING 12.00"),
    ]
    return V.bill_charges(o.select("bill_id", F.posexplode(F.array(*made)).alias("line_no", "line")), "bill_id", "line_no")


def inconsistent(spark, d):
    p = table(spark, d, "part").select(_k().alias("item_id"), tariff_code("p_partkey").alias("code"), F.when(_k() % 3 == 0, "").when(_k() % 3 == 1, F.substring(tariff_code("p_partkey"), 1, 2)).otherwise("42").alias("expected_chapter"), F.when(_k() % 4 == 0, "rule").alias("source"))
    return V.inconsistent(p).select("item_id", "code", "expected_chapter")


_CACHE = [("cold anvil", "42010000"), ("anvil", "73269000"), ("bolt", "42020001"), ("red bolt", "73181500"), ("blue", "42039999"), ("gizmo", "UNKNOWN"), ("w", "99999999"), ("large", "42110000")]


def reclassify(spark, d):
    """Parts whose code isn't of the expected chapter (42 for a third of them), looked up again."""
    cache = spark.createDataFrame(_CACHE, "key string, code string")
    valid = spark.createDataFrame([("42010000",), ("42020090",), ("73181500",)], "code string")
    invalid = spark.createDataFrame([("42110000", "73000000")], "code string, correct_code string")
    p = table(spark, d, "part").select(_k().alias("item_id"), F.lower("p_name").alias("term"), tariff_code("p_partkey").alias("code"), F.when(_k() % 3 == 0, "").when(_k() % 3 == 1, F.substring(tariff_code("p_partkey"), 1, 2)).otherwise("42").alias("expected_chapter"), F.when(_k() % 4 == 0, "rule").alias("source"))
    return V.reclassified(p, cache, valid, invalid).select("item_id", "new_code", "outcome")


def bills(spark, d):
    t = table(spark, d, "documents").select("source", F.concat(F.when(F.col("doc_id") % 5 == 0, "bl_").otherwise("doc_"), "doc_id").alias("name"), "text")
    return V.primary_bill(t, "source", ["THE", r"\bSHIPPER\b", r"ON\w+ ", "[0-9]{4}"])


def order_files(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    bracketed = F.concat(F.lit("PO/"), k, F.lit(" (2026-"), k % 500, F.lit("/ A-"), k % 9, F.lit(")"))
    rows = o.select(F.concat(F.lit("f"), k % 40, F.lit(".xlsx")).alias("file"), F.when(k % 6 > 0, bracketed).otherwise("PO").alias("order_ref"), F.when(k % 12 > 0, F.concat(F.lit("INV/SX/"), k % 300)).alias("number"))
    inv = o.select(F.col("o_custkey").alias("shipment_id"), F.when(k % 4 == 0, F.concat(F.lit("bm INV_SX_"), k % 350)).otherwise(F.concat(F.lit("2026"), k % 700)).alias("ref"))
    return V.order_file(rows, inv)


def extract(spark, d):
    p = table(spark, d, "part")
    items = p.select(_k().alias("item_id"), (_k() % 3 > 0).alias("is_assessed"))
    goods = p.filter("p_partkey % 11 > 0").select(_k().alias("item_id"), F.when(_k() % 13 == 0, " ab ").otherwise(F.col("p_name")).alias("commercial"), F.col("p_type").alias("goods"))
    links = p.filter("p_partkey % 2 = 0").select(_k().alias("item_id"), (_k() % 100).alias("inventory_id"))
    stock = p.filter("p_partkey < 80").select(_k().alias("inventory_id"), F.concat(F.lit("INV/"), _k()).alias("item_number"))
    return V.extracted(items, p.select(_k().alias("item_id"), F.when(_k() % 17 == 0, "123").otherwise(tariff_code("p_partkey")).alias("code")), goods, links, stock)


def dump_codes(spark, d):
    p = table(spark, d, "part")
    code = F.when(_k() % 4 == 0, F.substring(tariff_code("p_partkey"), 1, 6)).when(_k() % 4 == 1, F.concat(F.substring(tariff_code("p_partkey"), 1, 4), F.lit("."), F.substring(tariff_code("p_partkey"), 5, 4))).when(_k() % 4 == 2, "-----").otherwise("12345")
    line = F.concat_ws(" ", code, F.lower("p_name"), F.when(_k() % 3 == 0, "OTHER VALVES, (NONRETURN)"), F.when(_k() % 5 == 0, F.concat(F.lit("GLF/"), _k())))
    return V.dumped_codes(p.select("p_partkey", line.alias("line"))).groupBy("code", "commercial", "goods", "item_number").agg(F.count("*").alias("n"))


def header_map(spark, d):
    cells = F.array(F.col("p_name"), F.when(_k() % 2 == 0, " Item No").otherwise("Product"), F.when(_k() % 3 == 0, "Qty").otherwise("Units sold"), F.lit("Unit Price"), F.when(_k() % 5 > 0, "Extended Amount"))
    m = V.column_places(cells)
    return table(spark, d, "part").select("p_partkey", *[F.element_at(m, k).alias(k) for k in V.HEADERS])


def dump_items(spark, d):
    i = with_seq(invoice_items(spark, d))
    head = i.select("invoice_id").distinct().select("invoice_id", F.lit(0).alias("line_no"), F.lit("InvoiceNo\tItem Number\tItem Description\tQuantity\tUnit Cost").alias("line"))
    rows = i.select("invoice_id", F.col("seq").alias("line_no"), F.concat_ws("\t", "invoice_id", "sku", F.when(F.col("seq") % 4 == 0, " ").otherwise(F.col("description")), F.when(F.col("seq") % 3 == 0, "many").otherwise(F.col("quantity").cast("string")), F.concat(F.lit(" "), F.col("unit_cost").cast("string"))).alias("line"))
    return V.dump_items(head.unionByName(rows), "invoice_id", "line_no").withColumn("total_cost", F.col("total_cost").cast("decimal(18,4)"))


def delimited(spark, d):
    i = with_seq(invoice_items(spark, d))
    line = F.concat_ws("|", "description", F.when(F.col("seq") % 5 == 0, "x").otherwise(F.col("quantity").cast("string")), F.concat(F.lit("$"), F.col("unit_cost").cast("string")), F.when(F.col("seq") % 2 == 0, F.col("total_cost").cast("string")).otherwise(""))
    short = F.when(F.col("seq") % 7 == 0, "too|short").when(F.col("seq") == 6, "SKIP|1|2|3").otherwise(line)
    found = V.delimited_items(i.select("invoice_id", "seq", short.alias("line")), {"description": 0, "quantity": 1, "unit_price": 2, "total_cost": 3}, "|", ["^SKIP"])
    return found.drop("line").withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("quantity", "unit_price", "total_cost")})


def positional(spark, d):
    i = with_seq(invoice_items(spark, d))
    text = i.filter("NOT (invoice_id % 4 = 0 AND seq = 2)").select("invoice_id", (F.col("seq") * 2).alias("line_no"), "description").withColumnRenamed("description", "line")
    price = i.filter("NOT (invoice_id % 9 = 0 AND seq > 1)").select("invoice_id", (F.col("seq") * 2 + 101).alias("line_no"), F.when(F.col("seq") % 2 == 0, F.concat(F.col("seq"), F.lit(" "), _cents("total_cost"))).otherwise(F.concat(F.lit("$"), _cents("total_cost"))).alias("line"))
    return V.positional_items(text.unionByName(price), "invoice_id", "line_no")


def accuracy(spark, d):
    p = table(spark, d, "part")
    found = p.select(F.lit("single").alias("mode"), _k().alias("item_id"), F.when(_k() % 5 > 0, tariff_code("p_partkey")).alias("code")).unionByName(p.select(F.lit("batch").alias("mode"), _k().alias("item_id"), F.when(_k() % 3 == 0, "UNKNOWN").otherwise(F.col("p_brand")).alias("code")))
    return V.accuracy_of(found, p.select(_k().alias("item_id"), F.when(_k() % 2 == 0, tariff_code("p_partkey")).otherwise(F.col("p_brand")).alias("code")))


QUERIES = {
    "rule_query": rule_query, "unknown_products": unknown, "disable_code": disable, "learned_rules": learned, "doc_type_resolve": doc_type, "carrier_bill": carrier, "bogus_items": bogus,
    "reverse_scan": reverse_scan, "items_without_po": no_orders, "item_provenance": meta, "force_adjustment": corrections, "template_resolve": templates, "bill_charges": charges,
    "chapter_consistency": inconsistent, "chapter_reclassify": reclassify, "primary_bill": bills, "order_file": order_files, "assessed_extract": extract, "dumped_codes": dump_codes, "header_columns": header_map,
    "dump_items": dump_items, "delimited_items": delimited, "positional_items": positional, "bench_accuracy": accuracy,
}

_CODE = "lpad(CAST((p_partkey % 40) * 2300017 + 1010000 AS VARCHAR), 8, '0')"
_ITEMS = f"WITH {ITEMS_SQL}, {SEQ_SQL}"
_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{c}', '{k}', {p})" for _, i, c, k, p, _, _, _ in RULES) + ") t(id, code, category, patterns))"
_WORD = lambda w: f"len(list_filter(patterns, lambda p: contains(upper(p), '{w}'))) > 0"
_PLACES = ", ".join(
    "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(h[{i + 1}], {chr(39)}{w}{chr(39)})' for w in words)} THEN {i}" for i in range(5)) + f" END AS {k}" for k, words in V.HEADERS.items()
)

SQL = {
    "rule_query": f"""WITH r AS (SELECT p_partkey AS id, {_CODE} AS code, upper(p_type) AS category, string_split(upper(p_name), ' ') AS patterns, p_name, p_type FROM part),
        q AS (SELECT DISTINCT * FROM (SELECT unnest(string_split(lower(p_type), ' ')) AS word, 'all' AS field FROM part UNION ALL SELECT upper(w[1]) || lower(w[2:]), 'patterns' FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) UNION ALL SELECT left(code, 4), 'code' FROM r UNION ALL SELECT substr(p_name, 2, 2), 'patterns' FROM part))
        SELECT word, field, id, code FROM q, r WHERE (field IN ('all', 'code') AND contains(code, upper(word))) OR (field = 'all' AND contains(category, upper(word))) OR (field IN ('all', 'patterns') AND len(list_filter(patterns, lambda p: contains(p, upper(word)))) > 0)""",
    "unknown_products": "SELECT p_name AS description, count(*) AS n, min(p_partkey) AS first_item FROM part WHERE p_partkey % 3 < 2 OR p_partkey % 5 = 0 GROUP BY 1",
    "disable_code": """SELECT CAST(p_partkey AS VARCHAR) AS code, p_partkey % 7 <> 0 AS enabled, CASE WHEN p_partkey % 7 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' | ' ELSE '' END || 'Disabled: ' ||
        CASE WHEN p_partkey % 3 > 0 THEN p_type ELSE 'No reason provided' END WHEN p_partkey % 2 = 0 THEN p_brand END AS notes FROM part""",
    "learned_rules": "SELECT l_partkey AS id, min(l_suppkey) AS pattern FROM lineitem WHERE l_partkey % 2 = 1 OR l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY 1",
    "doc_type_resolve": "SELECT c_custkey, c_name, CASE WHEN contains(c_name, '#000000001') THEN '7400-000' WHEN contains(c_name, '5') OR contains(lower(c_name), 'customer#0000001') THEN '4200-000' ELSE '4000-000' END AS doc_type FROM customer",
    "carrier_bill": "SELECT o_orderkey, (o_orderkey % 4 = 0 AND length(CAST(o_orderkey AS VARCHAR)) BETWEEN 4 AND 8) OR (o_orderkey % 4 = 2 AND length(CAST(o_orderkey AS VARCHAR)) > 1 AND o_orderkey % 10 = 5) AS is_carrier FROM orders",
    "bogus_items": f"""{_ITEMS}, s AS (SELECT invoice_id, count(*) AS n, count(*) FILTER (invoice_id % 6 = 0 AND seq <= 3) AS l, count(*) FILTER (invoice_id % 5 = 0 AND seq % 2 = 1 AND total_cost > 0) AS q FROM numbered GROUP BY 1)
        SELECT invoice_id, n, CASE WHEN l > 0 AND l >= greatest(1, (n + 1) // 2) THEN 'labels' ELSE 'no quantity' END AS reason FROM s WHERE (l > 0 AND l >= greatest(1, (n + 1) // 2)) OR (q > 0 AND q >= greatest(1, (n + 1) // 2))""",
    "reverse_scan": """WITH p AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS page FROM lineitem), s AS (SELECT doc_id, count(*) AS pages, min(page) AS a, max(page) AS z, count(*) FILTER (page >= 4 AND doc_id % 3 = 0) AS h FROM p GROUP BY 1)
        SELECT doc_id, pages FROM s WHERE pages >= 3 AND a = 1 AND z >= 4 AND h = 1 AND doc_id % 6 = 0""",
    "items_without_po": f"""{_ITEMS} SELECT invoice_id, CAST(seq AS INT) AS seq, '' AS po_item_ref, '' AS po_item_desc, '' AS po_number, '' AS uom, CASE WHEN seq % 2 = 0 THEN sku ELSE 'ITEM-' || lpad(CAST(seq AS VARCHAR), 3, '0') END AS supplier_item, description, quantity,
        CASE WHEN seq % 3 > 0 THEN CAST(unit_cost AS DECIMAL(18,2)) WHEN total_cost <> 0 AND quantity <> 0 THEN CAST(((200 * CAST(total_cost * 100 AS HUGEINT) * 100 + CAST(quantity * 10000 AS HUGEINT)) // (2 * CAST(quantity * 10000 AS HUGEINT))) / 100 AS DECIMAL(18,2)) ELSE 0 END AS unit_price, total_cost, 0 AS match_score FROM numbered""",
    "item_provenance": f"""{_ITEMS} SELECT invoice_id, sha256('[' || string_agg('{{"seq":' || seq || ',"sku":"' || sku || '","tariff_code":"' || tariff_code || '","source":"' || CASE WHEN seq % 2 = 0 THEN 'rule' ELSE 'assessed' END || '"}}', ',' ORDER BY seq) || ']') AS meta_sha256 FROM numbered GROUP BY 1""",
    "force_adjustment": """WITH s AS (SELECT s_suppkey, CAST(s_acctbal AS DECIMAL(18,2)) AS a, CAST(s_suppkey AS DECIMAL(18,2)) AS r FROM supplier),
        f AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN CAST(a AS DOUBLE) ELSE 0.0 END AS term, CASE s_suppkey % 4 WHEN 0 THEN '=(T5+U5-W5)+' || r WHEN 1 THEN '=(T5+U5)+' || r WHEN 2 THEN CAST(a + r AS VARCHAR) ELSE CAST(r AS VARCHAR) END AS formula, a, r FROM s)
        SELECT s_suppkey, term, formula, CASE s_suppkey % 4 WHEN 2 THEN CAST(a + r + 1 + r AS VARCHAR) WHEN 3 THEN CAST(r + 1 + r AS VARCHAR) ELSE formula END AS again FROM f""",
    "template_resolve": "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN s_name WHEN 1 THEN '    ' || s_name WHEN 2 THEN 'USD' WHEN 4 THEN 'x ' END AS value FROM supplier",
    "bill_charges": """WITH s AS (SELECT s_suppkey AS bill_id, CAST(abs(s_acctbal) AS DECIMAL(18,2)) AS m FROM supplier)
        SELECT bill_id, 'ocean_freight' AS charge, m AS amount FROM s UNION ALL SELECT bill_id, 'landing', 12.00 FROM s UNION ALL SELECT bill_id, 'total_usd', m FROM s""",
    "chapter_consistency": f"SELECT p_partkey AS item_id, {_CODE} AS code, '42' AS expected_chapter FROM part WHERE p_partkey % 3 = 2 AND p_partkey % 4 > 0 AND left({_CODE}, 2) <> '42'",
    # of the cache, anvil and w are of other chapters and gizmo has no code; 42110000 is mapped to another chapter; 42020001 and 42039999 become what is near
    "chapter_reclassify": f"""WITH p AS (SELECT p_partkey AS k, lower(p_name) AS term, {_CODE} AS code, p_partkey % 3 = 2 AND p_partkey % 4 > 0 AND left({_CODE}, 2) <> '42' AS asked FROM part),
        c AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{c}')" for k, c in _CACHE if c != "UNKNOWN")}) t(key, found)),
        m AS (SELECT term, key, found FROM (SELECT DISTINCT term FROM p WHERE asked) JOIN c ON contains(term, key) OR contains(key, term)),
        one AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY term ORDER BY key <> term, key) = 1), two AS (SELECT * FROM m WHERE left(found, 2) = '42' QUALIFY row_number() OVER (PARTITION BY term ORDER BY key <> term, key) = 1),
        a AS (SELECT p.*, CASE WHEN left(one.found, 2) = '42' THEN one.found ELSE two.found END AS f, CASE WHEN left(one.found, 2) = '42' THEN 'cache' ELSE 'second' END AS how FROM p LEFT JOIN one USING (term) LEFT JOIN two USING (term)),
        x AS (SELECT *, CASE f WHEN '42010000' THEN '42010000' WHEN '42020001' THEN '42020090' WHEN '42039999' THEN '42039999' END AS fixed FROM a)
        SELECT k AS item_id, CASE WHEN asked AND fixed IS NOT NULL THEN fixed ELSE code END AS new_code, CASE WHEN NOT asked THEN 'consistent' WHEN fixed IS NOT NULL THEN how ELSE 'kept' END AS outcome FROM x""",
    "primary_bill": r"""WITH f AS (SELECT source, CASE WHEN doc_id % 5 = 0 THEN 'bl_' ELSE 'doc_' END || doc_id AS name, upper(coalesce(text, '')) AS t, doc_id % 5 = 0 AS bl FROM documents),
        s AS (SELECT *, CASE WHEN trim(t) = '' THEN -1 ELSE CAST(contains(t, 'THE') AS INT) + CAST(regexp_matches(t, '\bSHIPPER\b') AS INT) + CAST(regexp_matches(t, 'ON\w+ ') AS INT) + CAST(regexp_matches(t, '[0-9]{4}') AS INT) + CASE WHEN bl THEN 2 ELSE 0 END END AS score FROM f)
        SELECT source, name, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, name) AS r FROM s) WHERE r = 1""",
    "order_file": """WITH r AS (SELECT o_orderkey, 'f' || (o_orderkey % 40) || '.xlsx' AS file, unnest(['2026' || (o_orderkey % 500), 'a' || (o_orderkey % 9)]) AS ref FROM orders WHERE o_orderkey % 6 > 0),
        c AS (SELECT o_orderkey, 'f' || (o_orderkey % 40) || '.xlsx' AS file, 'inv_sx_' || (o_orderkey % 300) AS number FROM orders WHERE o_orderkey % 12 = 6),
        i AS (SELECT DISTINCT o_custkey AS shipment_id, CASE WHEN o_orderkey % 4 = 0 THEN 'bm inv_sx_' || (o_orderkey % 350) ELSE '2026' || (o_orderkey % 700) END AS ref FROM orders),
        h AS (SELECT shipment_id, file, count(DISTINCT o_orderkey) AS hits FROM (SELECT shipment_id, file, o_orderkey FROM r JOIN i USING (ref) UNION ALL SELECT shipment_id, file, o_orderkey FROM c JOIN i ON contains(ref, number)) GROUP BY 1, 2)
        SELECT shipment_id, file, hits FROM (SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY hits DESC, file) AS n FROM h) WHERE n = 1""",
    "assessed_extract": f"""SELECT p_partkey AS item_id, {_CODE} AS code, p_name AS commercial, p_type AS goods, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 100 BETWEEN 0 AND 79 AND p_partkey % 100 IN (SELECT p_partkey FROM part) THEN 'INV/' || (p_partkey % 100) ELSE '' END AS item_number
        FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 11 > 0 AND p_partkey % 13 > 0 AND p_partkey % 17 > 0 AND length(trim(p_name)) > 3""",
    "dumped_codes": f"""SELECT CASE p_partkey % 4 WHEN 0 THEN left({_CODE}, 6) || '00' ELSE {_CODE} END AS code, lower(p_name) AS commercial, CASE WHEN p_partkey % 3 = 0 THEN 'OTHER VALVES, (NONRETURN)' ELSE '' END AS goods,
        CASE WHEN p_partkey % 5 = 0 THEN 'GLF/' || p_partkey ELSE '' END AS item_number, count(*) AS n FROM part WHERE p_partkey % 4 < 2 GROUP BY 1, 2, 3, 4""",
    "header_columns": f"""WITH p AS (SELECT p_partkey, [lower(p_name), CASE WHEN p_partkey % 2 = 0 THEN 'item no' ELSE 'product' END, CASE WHEN p_partkey % 3 = 0 THEN 'qty' ELSE 'units sold' END, 'unit price', CASE WHEN p_partkey % 5 > 0 THEN 'extended amount' ELSE '' END] AS h FROM part)
        SELECT p_partkey, {_PLACES} FROM p""",
    "dump_items": f"""{_ITEMS} SELECT invoice_id, CAST(seq AS INT) AS line_no, sku, description, CASE WHEN seq % 3 = 0 THEN 0 ELSE quantity END AS quantity, unit_cost, CASE WHEN seq % 3 = 0 THEN 0 ELSE CAST(((CAST(quantity * 10000 AS HUGEINT) * CAST(unit_cost * 10000 AS HUGEINT) * 2 + 10000) // 20000) / 10000 AS DECIMAL(18,4)) END AS total_cost FROM numbered WHERE seq % 4 > 0""",
    "delimited_items": f"""{_ITEMS} SELECT invoice_id, CAST(seq AS INT) AS seq, description, CAST(quantity AS DECIMAL(18,2)) AS quantity, CAST(((CAST(unit_cost * 10000 AS HUGEINT) * 2 + 100) // 200) / 100 AS DECIMAL(18,2)) AS unit_price,
        CASE WHEN seq % 2 = 0 THEN total_cost ELSE CAST(((((CAST(quantity * 10000 AS HUGEINT) * CAST(unit_cost * 10000 AS HUGEINT) * 2 + 10000) // 20000) * 2 + 100) // 200) / 100 AS DECIMAL(18,2)) END AS total_cost FROM numbered WHERE seq % 5 > 0 AND seq % 7 > 0 AND seq <> 6""",
    "positional_items": f"""{_ITEMS}, a AS (SELECT invoice_id, description, row_number() OVER (PARTITION BY invoice_id ORDER BY seq) AS pos, count(*) OVER (PARTITION BY invoice_id) AS n FROM numbered WHERE NOT (invoice_id % 4 = 0 AND seq = 2)),
        b AS (SELECT invoice_id, CASE WHEN seq % 2 = 0 THEN seq ELSE 1 END AS quantity, total_cost AS unit_cost, row_number() OVER (PARTITION BY invoice_id ORDER BY seq) AS pos, count(*) OVER (PARTITION BY invoice_id) AS m FROM numbered WHERE NOT (invoice_id % 9 = 0 AND seq > 1))
        SELECT invoice_id, CAST(pos AS INT) AS "at", description, CAST(quantity AS INT) AS quantity, unit_cost, CAST(quantity * unit_cost AS DECIMAL(18,2)) AS total_cost FROM a JOIN b USING (invoice_id, pos) WHERE abs(n - m) <= 2""",
    "bench_accuracy": f"""WITH f AS (SELECT 'single' AS mode, p_partkey, CASE WHEN p_partkey % 5 > 0 THEN {_CODE} END AS code FROM part UNION ALL SELECT 'batch', p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_brand END FROM part),
        t AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN {_CODE} ELSE p_brand END AS own FROM part)
        SELECT mode, count(*) AS n, count(code) AS covered, count(*) FILTER (code = own) AS "right" FROM f JOIN t USING (p_partkey) GROUP BY 1""",
}

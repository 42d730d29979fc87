"""Queries of text parsing, page order and outcome rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.operators import parsing as P
from tradeloom.sources.tables import ITEMS_SQL, SEQ_SQL, invoice_items, table, with_seq


def _lines(spark, d):
    """Two lines an item: its words, and size and price; some items have their price left out."""
    i = with_seq(invoice_items(spark, d))
    price = F.when(F.col("seq") % 4 == 0, F.lit("no price")).otherwise(F.concat(F.lit("$"), F.col("total_cost").cast("string")))
    each = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("sku").alias("line")), F.struct(F.lit(1).alias("k"), F.concat_ws(" ", F.lit("lot"), price).alias("line")))).alias("l")
    return i.select(F.col("invoice_id").alias("doc_id"), "seq", each).select("doc_id", (F.col("seq") * 2 + F.col("l.k")).alias("line_no"), "l.line")


def multiline(spark, d):
    return P.multiline_items(_lines(spark, d))


def columns(spark, d):
    i = with_seq(invoice_items(spark, d))
    return P.column_items(i.filter("seq <> 2").select("invoice_id", "seq", F.col("sku").alias("description")), i.filter("seq <> 1").select("invoice_id", "seq", F.col("total_cost").alias("price")), "invoice_id", "seq")


def dump(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    line = F.when(k % 10 == 0, "sku\tQuantity\tprice").when(k % 10 == 1, "Total\t1\t2").when(k % 10 == 2, "short\tone").otherwise(F.concat_ws("\t", "s_name", F.concat(k, F.lit(" ")), F.format_string("%.2f", "s_acctbal")))
    rows = P.table_rows(s.select("s_suppkey", k.alias("line_no"), line.alias("line")), "s_suppkey", ["sku", "quantity", "price"])
    return rows.select("s_suppkey", "sku", P.typed(F.col("quantity"), "integer").alias("quantity"), P.typed(F.col("price"), "currency").alias("price"))


def clean(spark, d):
    rules = [(r"(?i)\bth", "T"), (r"[.,;]+", ""), (r"\s+", " ")]
    return table(spark, d, "documents").select("doc_id", F.sha2(P.cleaned(F.col("text"), rules).cast("binary"), 256).alias("text_sha256"))


def sensible_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(P.sensible(F.col("line")).cast("int")).alias("sensible"))


def positions(spark, d):
    return table(spark, d, "documents").select("doc_id", P.page_position(F.col("text"), r"licen[cs]ed?|token", r" the | die | les? | que |@mail").alias("position"))


def page_order(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("ident"), F.when(F.col("event_id") % 11 > 0, F.col("event_id") % 7).alias("marker"))
    return P.pages_ordered(e, "user_id", "event_id", "ident", "marker").select("user_id", "event_id", "island", "place")


def markers(spark, d):
    k = F.col("p_partkey")
    text = F.concat_ws(" ", F.lit("Page 1 of 3"), F.repeat(F.lit("x"), (k % 800).cast("int")), F.when(k % 3 == 0, F.concat_ws(" ", F.lit("PAGE"), k % 9, F.lit("of"), k % 25)))
    return table(spark, d, "part").select("p_partkey", P.page_marker(text).alias("page"))


def confidence(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("cluster"), F.concat(F.when(F.col("l_partkey") % 2 == 0, " A").otherwise("a"), F.col("l_suppkey") % 2).alias("text"))
    return P.reading_confidence(t)


def packages(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_custkey")
    rows = o.select(k.alias("shipment_id"), F.lit(1).cast("long").alias("packages"), F.when(k % 3 == 0, k % 20).alias("bill_packages"), F.when(k % 3 < 2, k % 12).alias("manifest_packages"))
    return P.packages_checked(rows)


def splits(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("p"))
    return P.split_needed(o, "o_custkey", ["o_orderstatus", "p"])


def rates(spark, d):
    return P.outcome_rates(table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "N", "modified").otherwise("accepted").alias("outcome")))


def reread(spark, d):
    """Readings without every third invoice's second item; a permissive one has all, with the right unit price for even invoices."""
    i = with_seq(invoice_items(spark, d)).select("invoice_id", "seq", "quantity", F.col("unit_cost").cast("decimal(18,4)").alias("unit_cost"), F.col("total_cost").cast("decimal(18,2)").alias("total_cost"))
    subtotals = i.groupBy("invoice_id").agg(F.sum("total_cost").alias("subtotal"))
    again = i.withColumn("unit_cost", F.when(F.col("invoice_id") % 2 == 0, F.col("total_cost").cast("decimal(18,4)")).otherwise(F.col("unit_cost")))
    found = P.anchored(i.filter("NOT (invoice_id % 3 = 0 AND seq = 2)"), again, subtotals)
    return found.groupBy("invoice_id", "reread").agg(F.count("*").alias("n"), F.sum("total_cost").cast("decimal(18,2)").alias("total"))


QUERIES = {
    "subtotal_anchored": reread,
    "multiline_items": multiline, "column_items": columns, "table_rows": dump, "clean_rules": clean, "sensible_line": sensible_lines, "page_position": positions, "page_order": page_order,
    "page_marker": markers, "ocr_confidence": confidence, "package_check": packages, "shipment_split": splits, "accuracy_report": rates,
}

_EV = "e AS (SELECT user_id, event_id, last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS f, CASE WHEN event_id % 11 > 0 THEN event_id % 7 END AS marker FROM events)"
SQL = {
    "subtotal_anchored": f"""WITH {ITEMS_SQL}, {SEQ_SQL}, i AS (SELECT invoice_id, CAST(total_cost AS DECIMAL(18,2)) AS t, round(CAST(unit_cost AS DECIMAL(18,4)), 2) AS u, NOT (invoice_id % 3 = 0 AND seq = 2) AS has FROM numbered),
        s AS (SELECT invoice_id, sum(t) AS subtotal, sum(t) FILTER (has) AS own, count(*) FILTER (has) AS n_own, sum(CASE WHEN invoice_id % 2 = 0 THEN t ELSE u END) AS again, count(*) AS n_all FROM i GROUP BY 1),
        c AS (SELECT *, abs(own - subtotal) > 0.02 AND abs(again - subtotal) <= 0.02 AS reread FROM s)
        SELECT invoice_id, reread, CASE WHEN reread THEN n_all ELSE n_own END AS n, CAST(CASE WHEN reread THEN again ELSE own END AS DECIMAL(18,2)) AS total FROM c""",
    "multiline_items": f"""WITH {ITEMS_SQL}, {SEQ_SQL}, l AS (SELECT invoice_id AS doc_id, seq, sku, total_cost, seq % 4 > 0 AS priced FROM numbered),
        g AS (SELECT *, coalesce(sum(CAST(priced AS INT)) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS item FROM l)
        SELECT doc_id, item, string_agg(sku || ' lot' || CASE WHEN priced THEN '' ELSE ' no price' END, ' ' ORDER BY seq) AS description, max(total_cost) FILTER (priced) AS price FROM g GROUP BY 1, 2 HAVING bool_or(priced)""",
    "column_items": f"""WITH {ITEMS_SQL}, {SEQ_SQL}, a AS (SELECT invoice_id, row_number() OVER (PARTITION BY invoice_id ORDER BY seq) AS n, sku AS description FROM numbered WHERE seq <> 2),
        b AS (SELECT invoice_id, row_number() OVER (PARTITION BY invoice_id ORDER BY seq) AS n, total_cost AS price FROM numbered WHERE seq <> 1) SELECT * FROM a FULL JOIN b USING (invoice_id, n)""",
    "table_rows": "SELECT s_suppkey, s_name AS sku, CAST(s_suppkey AS INT) AS quantity, CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS price FROM supplier WHERE s_suppkey % 10 > 2",
    "clean_rules": r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bth', 'T', 'g'), '[.,;]+', '', 'g'), '\s+', ' ', 'g'))) AS text_sha256 FROM documents",
    "sensible_line": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), w AS (SELECT *, list_filter(string_split_regex(line, '\s+'), lambda x: x <> '') AS ws FROM l)
        SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(line, '\d+\.\d{2}\b') OR (len(ws) >= 2 AND 2 * len(list_filter(ws, lambda x: length(x) BETWEEN 2 AND 15 AND regexp_matches(x, '^[A-Za-z0-9.,''-]+$'))) > len(ws))) AS sensible FROM w GROUP BY 1""",
    "page_position": r"""WITH p AS (SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), 'licen[cs]ed?|token'))) AS h, len(list_distinct(regexp_extract_all(lower(text), ' the | die | les? | que |@mail'))) AS f FROM documents)
        SELECT doc_id, CASE WHEN h >= 1 AND h >= f THEN 'header' WHEN f >= 2 THEN 'footer' ELSE 'body' END AS position FROM p""",
    "page_order": f"""WITH {_EV}, i AS (SELECT *, CAST(sum(CASE WHEN f <> b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (SELECT *, lag(f) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM e)),
        s AS (SELECT user_id, island, count(marker) = count(*) AND count(DISTINCT marker) = count(*) AS ok FROM i GROUP BY 1, 2)
        SELECT user_id, event_id, island, row_number() OVER (PARTITION BY user_id, island ORDER BY CASE WHEN ok THEN marker ELSE 0 END, event_id) AS place FROM i JOIN s USING (user_id, island)""",
    "page_marker": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 9 >= 1 AND p_partkey % 9 <= p_partkey % 25 AND p_partkey % 25 <= 20 THEN p_partkey % 9 END WHEN 12 + p_partkey % 800 <= 400 THEN 1 END AS page FROM part""",
    "ocr_confidence": """WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber, count(DISTINCT l_suppkey % 2) = 1 AS same FROM lineitem GROUP BY 1, 2)
        SELECT doc_id, CAST(round(CAST(count(*) FILTER (same) / count(*) AS DECIMAL(18,8)), 3) AS DOUBLE) AS confidence, count(*) AS clusters FROM c GROUP BY 1""",
    "package_check": """WITH s AS (SELECT o_custkey AS shipment_id, count(*) AS packages, CASE o_custkey % 3 WHEN 0 THEN o_custkey % 20 WHEN 1 THEN o_custkey % 12 ELSE count(*) END AS expected FROM orders GROUP BY 1) SELECT *, packages = expected AS agrees FROM s""",
    "shipment_split": "SELECT o_custkey, count(DISTINCT o_orderstatus || left(o_orderpriority, 1)) AS groups FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus || left(o_orderpriority, 1)) > 1",
    "accuracy_report": """WITH c AS (SELECT CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'N' THEN 'modified' ELSE 'accepted' END AS outcome, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT outcome, n, CAST(round(CAST(n / (SELECT sum(n) FROM c) AS DECIMAL(18,8)), 4) AS DOUBLE) AS share FROM c""",
}

"""Queries of history, sets, quality, documents and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.operators import documents as D
from tradeloom.operators import history as H
from tradeloom.operators import quality as Q
from tradeloom.sources.tables import INVOICES_SQL, ITEMS_SQL, SEQ_SQL, invoice_items, invoices, table, with_seq


def _events(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", "event_type", F.col("value").cast("decimal(18,2)").alias("confidence"))


def supersede(spark, d):
    return H.superseded(_events(spark, d), "user_id", "event_type", "event_id")


def corrections(spark, d):
    return H.changes(_events(spark, d), "user_id", "event_type", "event_id")


def upsert(spark, d):
    old = table(spark, d, "part").filter("p_partkey % 3 > 0").select("p_partkey", "p_name", "p_brand")
    new = table(spark, d, "lineitem").filter("l_partkey % 4 > 0").select(F.col("l_partkey").alias("p_partkey"), F.when(F.col("l_quantity") > 25, F.concat(F.lit("q"), F.col("l_quantity").cast("int"))).alias("p_name"), F.lit(None).cast("string").alias("p_brand"), "l_orderkey", "l_linenumber", "l_extendedprice")
    return H.upserted(old, new, "p_partkey", F.struct("l_orderkey", "l_linenumber", "l_extendedprice").desc())


def fill_only(spark, d):
    s = table(spark, d, "supplier")
    old = s.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "").when(F.col("s_suppkey") % 3 == 1, F.lit(None)).otherwise(F.col("s_name")).alias("name"))
    return H.filled_only(old, s.select("s_suppkey", F.upper("s_name").alias("name")), "s_suppkey")


def refresh(spark, d):
    p = table(spark, d, "part")
    brand = F.col("p_brand").alias("code")
    return H.codes_refreshed(p.filter("p_size < 20").select(brand), p.filter("p_size > 45").select(F.concat(brand, F.lit("x")).alias("code")), p.filter("p_partkey < 10").select(brand))


def duplicate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content"))
    return H.duplicate_pairs(docs, ["content"], "doc_id")


def stale(spark, d):
    return H.stale(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


def layouts(spark, d):
    p = table(spark, d, "part")
    a = p.filter("p_partkey % 2 = 0").select("p_partkey", "p_name", F.col("p_size").alias("demand"))
    b = p.filter("p_partkey % 2 = 1").select("p_partkey", "p_name", F.col("p_brand").alias("supplier_sku"))
    return H.layouts_united(a, b)


def resend(spark, d):
    from tradeloom.functions.codes import params_hash

    o = table(spark, d, "orders")
    sent = o.select("o_orderkey", params_hash(F.col("o_orderstatus"), F.col("o_custkey")).alias("params_hash"))
    now = o.select("o_orderkey", params_hash(F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus")), F.col("o_custkey")).alias("params_hash"))
    return H.resend_due(sent, now, "o_orderkey")


def issues(spark, d):
    k = F.col("invoice_id") + F.col("seq")
    items = with_seq(invoice_items(spark, d)).withColumns({
        "tariff_code": F.when(k % 11 == 0, "").when(k % 13 == 0, "123").otherwise(F.col("tariff_code")),
        "description": F.when(k % 17 == 0, "goods").when(k % 19 == 0, "#1 $2 %3").when(k % 23 == 0, "Balance due").otherwise(F.col("description")),
        "total_cost": F.when(k % 29 == 0, F.lit(0)).otherwise(F.col("total_cost")).cast("decimal(18,2)"),
    })
    return Q.findings(items, {n: c for n, c in Q.item_checks().items() if n != "VARIANCE"}, "invoice_id", "seq")


def duplicate_items(spark, d):
    return Q.duplicates(invoice_items(spark, d), ["supplier_id", "part_id"])


def tariff_conflicts(spark, d):
    products = {"metal": ["bolt", "rod", "anvil"], "toy": ["gizmo", "widget"], "ring": ["ring"]}
    chapters = {"01": ["toy"], "12": ["metal", "toy"], "40": ["ring"], "70": ["metal"]}
    return Q.conflicts(invoice_items(spark, d), products, chapters).groupBy("tariff_code", "description").agg(F.count("*").alias("n"))


def zero_filter(spark, d):
    items = invoice_items(spark, d).withColumn("quantity", F.when(F.col("line") == 3, F.lit(0)).otherwise(F.col("quantity")).cast("decimal(18,4)"))
    totals = invoices(spark, d).select("invoice_id", F.when(F.col("invoice_id") % 2 == 0, F.lit(0)).otherwise(F.col("invoice_total")).alias("invoice_total"))
    return Q.zero_items_dropped(items, totals).groupBy("invoice_id").agg(F.count("*").alias("n"))


def line_counts(spark, d):
    items = invoice_items(spark, d).select("invoice_id", "line")
    return Q.counts_compared(items, items.filter("line <> 4"), "invoice_id")


def quality_scores(spark, d):
    docs = table(spark, d, "documents").select("doc_id", Q.scan_score(F.col("text")).alias("score"))
    return docs.select("doc_id", "score", Q.scan_grade(F.col("score")).alias("grade"))


SPECS = [
    ("mail", 5, [], ["@mail", "example.com"], []),
    ("secret", 9, ["token", "="], [], ["@mail"]),
    ("sentence", 1, ["the", "and"], ["tion"], ["$$$"]),
    ("french", 1, ["le"], ["eau", "oi"], []),
    ("never", 99, [], [], []),
]
TYPES = {"letter": (["the", "and", "with", "dear"], {"@": 0.2}), "lettre": (["le ", "la ", "avec", "pour"], {"é": 0.1}), "brief": (["der ", "die ", "und", "mit"], {"ß": 0.1, "ü": 0.1})}


def formats(spark, d):
    specs = spark.createDataFrame(SPECS, "name string, priority int, all_of array<string>, any_of array<string>, none_of array<string>")
    return D.format_detected(table(spark, d, "documents").select("doc_id", "text"), specs).select("doc_id", "format")


def types(spark, d):
    return table(spark, d, "documents").select("doc_id", D.type_scored(F.col("text"), TYPES).alias("doc_type"))


def _lines(spark, d):
    """Invoice lines written out from items."""
    i = with_seq(invoice_items(spark, d))
    return i.select(F.col("invoice_id").alias("doc_id"), F.col("seq").alias("line_no"), F.concat_ws(" ", F.when(F.col("seq") % 2 == 0, F.col("quantity").cast("int").cast("string")), "description", F.format_number("total_cost", 2), F.when(F.col("seq") % 3 == 0, "XCD")).alias("line"))


def line_items(spark, d):
    return D.items_in_lines(_lines(spark, d))


def price_map(spark, d):
    return D.price_tokens(_lines(spark, d).withColumn("line", F.replace("line", F.lit(","), F.lit(""))))


def orphan_price(spark, d):
    lines = _lines(spark, d).withColumn("line", F.replace("line", F.lit(","), F.lit("")))
    gaps = invoice_items(spark, d).groupBy(F.col("invoice_id").alias("doc_id")).agg((F.max("total_cost") + F.lit(0.1).cast("decimal(18,2)")).cast("decimal(18,2)").alias("gap"))
    return D.recovered_price(lines, gaps)


def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(D.markup_text(F.col("html")).cast("binary"), 256).alias("text_sha256"), F.length(D.section(F.col("html"), "<article>", ["</article>", "</body>"])).alias("article_chars"))


def chat_counts(spark, d):
    t = table(spark, d, "conversations")
    return t.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.sum((F.col("role") == "user").cast("int")).alias("asked"))


def chat_search(spark, d):
    t = table(spark, d, "conversations").filter(F.col("text").ilike("%the%") & F.col("role").isin("user", "assistant"))
    return t.select("conv_id", "turn", "role").orderBy(F.col("conv_id").desc(), "turn").limit(50)


def like_search(spark, d):
    p = table(spark, d, "part").filter(F.col("p_name").ilike("%BOLT%"))
    return p.select("p_partkey", "p_name", F.round((F.lit(4) / F.length("p_name")).cast("decimal(18,8)"), 4).cast("double").alias("score"))


def fuzzy_lookup(spark, d):
    """Parts whose name or brand has one of several words, shortest names first: a top-k report."""
    hit = F.exists(F.array(F.lit("anvil"), F.lit("cold")), lambda t: F.contains(F.lower(F.concat_ws(" ", "p_name", "p_brand")), t))
    p = table(spark, d, "part").filter(hit & (F.col("p_size") > 10)).groupBy("p_name").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"), F.count("*").alias("n"))
    return p.orderBy(F.length("p_name"), "p_name").limit(15)


def journal(spark, d):
    e = table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))
    return e.orderBy(F.col("n").desc(), "event_type", "k").limit(10)


def statistics(spark, d):
    p = table(spark, d, "part")
    return p.agg(F.count("*").alias("codes"), F.countDistinct("p_brand").alias("brands"), F.countDistinct(F.substring("p_name", 1, 2)).alias("chapters"))


QUERIES = {
    "supersede_scd2": supersede, "corrections_lag": corrections, "upsert_coalesce": upsert, "supplier_fill_only": fill_only, "code_refresh": refresh, "dup_invoice_pairs": duplicate,
    "stale_files": stale, "union_layouts": layouts, "stale_resend": resend, "issue_scan": issues, "duplicate_items": duplicate_items, "tariff_product_conflict": tariff_conflicts,
    "zero_value_filter": zero_filter, "line_count_verify": line_counts, "ocr_quality_score": quality_scores, "format_detect": formats, "doc_type_score": types,
    "line_items": line_items, "price_token_map": price_map, "orphan_price_recovery": orphan_price, "page_text": page_text, "conversation_counts": chat_counts,
    "chat_search": chat_search, "description_like": like_search, "tariff_lookup_fuzzy": fuzzy_lookup, "journal_summary": journal, "cet_stats": statistics,
}

_E = "e AS (SELECT user_id, event_id, event_type, CAST(value AS DECIMAL(18,2)) AS confidence, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events)"
_L = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]"
_HAS = lambda v, op: f"len(list_filter({_L(v)}, lambda p: contains(lower(text), p))) {op}"
_SPEC_SQL = " ".join(f"WHEN {_HAS(n, '= 0')} AND {_HAS(a, f'= {len(a)}')} AND {'true' if not o else _HAS(o, '> 0')} THEN '{name}'" for name, _, a, o, n in sorted(SPECS, key=lambda s: (-s[1], s[0])) if a or o)
_SCORES = [(name, " + ".join([f"(" + " + ".join(f"CAST(contains(lower(text), '{k}') AS INT)" for k in ks) + f") / {float(len(ks))}"] + [f"CASE WHEN contains(lower(text), '{k}') THEN {b}::DOUBLE ELSE 0 END" for k, b in bs.items()])) for name, (ks, bs) in TYPES.items()]
_LINES_SQL = f"""WITH {ITEMS_SQL}, {SEQ_SQL}, l AS (SELECT invoice_id AS doc_id, seq AS line_no, CASE WHEN seq % 2 = 0 THEN CAST(quantity AS INT) ELSE 1 END AS quantity, description, total_cost AS amount FROM numbered)"""
_K = "(invoice_id + seq)"

SQL = {
    "supersede_scd2": f"""WITH {_E}, r AS (SELECT *, sum(CASE WHEN old IS NULL OR old <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
        m AS (SELECT user_id, run, event_type, min(event_id) AS since, max(confidence) AS confidence, count(*) AS times FROM r GROUP BY 1, 2, 3)
        SELECT user_id, event_type, since, confidence, times, lead(since) OVER (PARTITION BY user_id ORDER BY run) AS superseded_by, lead(since) OVER (PARTITION BY user_id ORDER BY run) IS NULL AS is_active FROM m""",
    "corrections_lag": f"WITH {_E} SELECT user_id, event_id, old, event_type AS new FROM e WHERE old <> event_type",
    "upsert_coalesce": """WITH o AS (SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey % 3 > 0), n AS (SELECT l_partkey AS k, CASE WHEN l_quantity > 25 THEN 'q' || CAST(l_quantity AS INT) END AS nm,
          row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS r FROM lineitem WHERE l_partkey % 4 > 0)
        SELECT coalesce(p_partkey, k) AS p_partkey, coalesce(nm, p_name) AS p_name, p_brand FROM o FULL JOIN (SELECT * FROM n WHERE r = 1) ON p_partkey = k""",
    "supplier_fill_only": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN upper(s_name) ELSE s_name END AS name FROM supplier",
    "code_refresh": "SELECT code FROM (SELECT p_brand AS code FROM part WHERE p_size < 20 UNION SELECT p_brand || 'x' FROM part WHERE p_size > 45) WHERE code NOT IN (SELECT p_brand FROM part WHERE p_partkey < 10)",
    "dup_invoice_pairs": "WITH d AS (SELECT doc_id, sha256(text) AS content, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) SELECT content, first, doc_id AS other FROM d WHERE doc_id <> first",
    "stale_files": "SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "union_layouts": "SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS demand, CASE WHEN p_partkey % 2 = 1 THEN p_brand END AS supplier_sku FROM part",
    "stale_resend": "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0",
    "issue_scan": f"""WITH {ITEMS_SQL}, {SEQ_SQL}, i AS (SELECT invoice_id, seq, quantity, CASE WHEN {_K} % 11 = 0 THEN '' WHEN {_K} % 13 = 0 THEN '123' ELSE tariff_code END AS code,
          CASE WHEN {_K} % 17 = 0 THEN 'goods' WHEN {_K} % 19 = 0 THEN '#1 $2 %3' WHEN {_K} % 23 = 0 THEN 'Balance due' ELSE description END AS text, CASE WHEN {_K} % 29 = 0 THEN 0 ELSE total_cost END AS total_cost FROM numbered),
        f AS (SELECT invoice_id, seq, unnest([CASE WHEN code = '' THEN 'MISSING_TARIFF' END, CASE WHEN code <> '' AND length(code) <> 8 THEN 'INVALID_TARIFF' END, CASE WHEN total_cost = 0 THEN 'ZERO_VALUE' END,
          CASE WHEN text = 'Balance due' THEN 'PAYMENT_LINE' END, CASE WHEN text = 'goods' THEN 'GENERIC' END, CASE WHEN text LIKE '#1%' THEN 'GARBAGE' END, CASE WHEN quantity = 0 AND total_cost > 0 THEN 'NO_QUANTITY' END]) AS finding FROM i)
        SELECT * FROM f WHERE finding IS NOT NULL""",
    "duplicate_items": f"WITH {ITEMS_SQL} SELECT supplier_id, part_id, count(*) AS n FROM items GROUP BY 1, 2 HAVING count(*) > 1",
    "tariff_product_conflict": f"""WITH {ITEMS_SQL}, w AS (SELECT tariff_code, description, string_split(lower(description), ' ') AS ws FROM items),
        n AS (SELECT *, list_filter([CASE WHEN list_has_any(ws, ['bolt', 'rod', 'anvil']) THEN 'metal' END, CASE WHEN list_has_any(ws, ['gizmo', 'widget']) THEN 'toy' END, CASE WHEN list_contains(ws, 'ring') THEN 'ring' END], lambda x: x IS NOT NULL) AS named,
          CASE left(tariff_code, 2) WHEN '01' THEN ['toy'] WHEN '12' THEN ['metal', 'toy'] WHEN '40' THEN ['ring'] WHEN '70' THEN ['metal'] END AS allowed FROM w)
        SELECT tariff_code, description, count(*) AS n FROM n WHERE len(named) > 0 AND allowed IS NOT NULL AND NOT list_has_any(named, allowed) GROUP BY 1, 2""",
    "zero_value_filter": f"WITH {ITEMS_SQL} SELECT invoice_id, count(*) AS n FROM items WHERE invoice_id % 2 = 0 OR NOT (line = 3 OR quantity = 0 OR (total_cost = 0 AND unit_cost = 0)) GROUP BY 1",
    "line_count_verify": "SELECT l_orderkey AS invoice_id, count(*) AS source_rows, count(*) FILTER (l_linenumber <> 4) AS written_rows FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linenumber = 4) > 0",
    "ocr_quality_score": r"""WITH s AS (SELECT doc_id, CASE WHEN length(text) >= 500 THEN 10 WHEN length(text) >= 100 THEN 5 ELSE 0 END + least(len(regexp_extract_all(text, '[0-9]+\.[0-9]{2}')) * 5, 25)
          + CASE WHEN contains(lower(text), 'total') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '(invoice|order) *(no|number|#)') THEN 10 ELSE 0 END
          + least(len(regexp_extract_all(text, '(?m)^\S+ \S+ \S+')) * 5, 25) + least(len(regexp_extract_all(lower(text), 'invoice|total|date|quantity|description|price')) * 2, 10) AS score FROM documents)
        SELECT doc_id, score, CASE WHEN score >= 70 THEN 'good' WHEN score >= 40 THEN 'fair' WHEN score >= 15 THEN 'poor' ELSE 'unusable' END AS grade FROM s""",
    "format_detect": f"SELECT doc_id, CASE {_SPEC_SQL} END AS format FROM documents",
    "doc_type_score": f"""WITH s AS (SELECT doc_id, {", ".join(f"{e} AS s{i}" for i, (_, e) in enumerate(_SCORES))} FROM documents)
        SELECT doc_id, CASE WHEN greatest(s0, s1, s2) < 0.15 THEN 'unknown' {" ".join(f"WHEN s{i} = greatest(s0, s1, s2) THEN '{n}'" for i, (n, _) in enumerate(_SCORES))} END AS doc_type FROM s""",
    "line_items": f"{_LINES_SQL} SELECT * FROM l",
    "price_token_map": f"{_LINES_SQL} SELECT CAST(amount AS VARCHAR) AS token, count(*) AS n, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM l GROUP BY 1",
    "orphan_price_recovery": f"""{_LINES_SQL}, g AS (SELECT doc_id, max(amount) + 0.1 AS gap FROM l GROUP BY 1), c AS (SELECT doc_id, amount AS price, abs(amount - gap) AS off FROM l JOIN g USING (doc_id) WHERE abs(amount - gap) <= 0.25)
        SELECT doc_id, price, CAST(off AS DECIMAL(18,2)) AS off FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY off, price) AS r FROM c) WHERE r = 1""",
    "page_text": r"""WITH t AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS x FROM pages)
        SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) AS text_sha256,
          CASE WHEN contains(html, '<article>') THEN length(regexp_extract(html, '(?s)<article>(.*?)(</article>|</body>|$)', 1)) ELSE 0 END AS article_chars FROM t""",
    "conversation_counts": "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, count(*) FILTER (role = 'user') AS asked FROM conversations GROUP BY 1",
    "chat_search": "SELECT conv_id, turn, role FROM conversations WHERE text ILIKE '%the%' AND role IN ('user', 'assistant') ORDER BY conv_id DESC, turn LIMIT 50",
    "description_like": "SELECT p_partkey, p_name, CAST(round(CAST(4 / length(p_name) AS DECIMAL(18,8)), 4) AS DOUBLE) AS score FROM part WHERE p_name ILIKE '%BOLT%'",
    "tariff_lookup_fuzzy": """SELECT p_name, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS brands, count(*) AS n FROM part WHERE (contains(lower(p_name || ' ' || p_brand), 'anvil') OR contains(lower(p_name || ' ' || p_brand), 'cold')) AND p_size > 10
        GROUP BY 1 ORDER BY length(p_name), p_name LIMIT 15""",
    "journal_summary": "SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY n DESC, event_type, k LIMIT 10",
    "cet_stats": "SELECT count(*) AS codes, count(DISTINCT p_brand) AS brands, count(DISTINCT left(p_name, 2)) AS chapters FROM part",
}

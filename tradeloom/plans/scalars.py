"""Queries of wave one: normalisation and parsing over documents, parts, suppliers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.functions import codes, money, text
from tradeloom.sources.tables import table

def normalised(spark, d):
    keys = table(spark, d, "documents").select("doc_id", text.history_key(F.col("text")).alias("h"), text.assessed_key(F.col("text")).alias("a"), text.extract_key(F.col("text")).alias("e"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return keys.select("doc_id", digest("h").alias("history_key"), digest("a").alias("assessed_key"), digest("e").alias("extract_key"), text.specific_enough(F.col("a")).alias("specific"))


def terms(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", text.search_terms(F.col("text")).alias("terms"), text.simplified(F.col("text")).alias("simplified"), F.sha2(text.rule_text(F.col("text")).cast("binary"), 256).alias("rule_text")
    )


def product_types(spark, d):
    p = table(spark, d, "part")
    described = F.concat_ws(" ", "p_name", F.concat(F.lit("Size "), F.col("p_size")), F.concat(F.col("p_size"), F.lit("mm")), F.col("p_type"))
    return p.select("p_partkey", text.product_type(described).alias("product_type"), text.cleaned_label(F.concat(F.lit(" - "), "p_name", F.lit("  range - "), "p_type")).alias("label"))


def _amount():
    return F.concat(F.element_at(F.array(*map(F.lit, ("$", "€", "(", "-", "", "£ "))), (F.col("c_custkey") % 6 + 1).cast("int")), F.format_number("c_acctbal", 2), F.when(F.col("c_custkey") % 6 == 2, ")").otherwise(""))


def currencies(spark, d):
    """Balances written in six ways; negative ones in brackets or with two signs are included."""
    return table(spark, d, "customer").select("c_custkey", money.currency(_amount()).alias("amount"))


def recognised_numbers(spark, d):
    """Order totals as recognition may give them."""
    k, cents = F.col("o_orderkey"), F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string")
    mangled = (
        F.when(k % 5 == 0, F.replace(cents, F.lit("."), F.lit(",")))
        .when(k % 5 == 1, F.translate(cents, "15", "lS"))
        .when(k % 5 == 2, F.replace(cents, F.lit("."), F.lit(" ")))
        .when(k % 5 == 3, F.concat(F.lit("$"), cents, F.lit(".;")))
        .otherwise(F.concat(F.lit("x"), cents))
    )
    return table(spark, d, "orders").select(k.alias("o_orderkey"), money.recognised(mangled).alias("value"), money.spaced_price(mangled).alias("price"))


def hs_levels(spark, d):
    from tradeloom.sources.tables import tariff_code

    p = table(spark, d, "part").select("p_partkey", tariff_code("p_partkey").alias("code"))
    return p.select("p_partkey", "code", *codes.levels(F.col("code")), codes.is_leaf(F.col("code")).alias("is_leaf"), codes.chapter_ok(F.col("code")).alias("chapter_ok"))


def references(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    return s.select(
        "s_suppkey",
        codes.sku(F.concat(F.lit("ab-"), k, F.lit(" x"))).alias("sku"),
        codes.reference(F.concat(F.lit("INV00"), k)).alias("ref"),
        codes.reference(F.lit("INV000")).alias("empty_ref"),
        codes.file_reference(F.concat(F.lit("in/box/INV"), k, F.lit(" (2).pdf"))).alias("file_ref"),
        F.to_date(F.coalesce(*[F.try_to_timestamp(_date_text(), F.lit(f)) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "MMM d, yyyy")])).cast("string").alias("day"),
    )


def _date_text():
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") % 366).cast("int"))
    k = F.col("s_suppkey") % 4
    return F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "dd/MM/yyyy")).when(k == 2, F.date_format(day, "MMM d, yyyy")).otherwise("soon")


_RATE_TEXTS = ("Free", "A", "0-5%", "20", "0.2", " free ", "5%", "")


def rates(spark, d):
    texts = F.array(*map(F.lit, _RATE_TEXTS))
    return table(spark, d, "part").select("p_partkey", codes.rate(F.element_at(texts, (F.col("p_partkey") % len(_RATE_TEXTS) + 1).cast("int"))).alias("rate"))


def bundles(spark, d):
    """Sets and the parts that their references list."""
    p = table(spark, d, "part")
    ref = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("MF0"), F.col("p_partkey") % 7 + 1, F.lit("-0"), F.col("p_partkey") % 9 + 1)).otherwise(F.concat(F.lit("BASE"), F.col("p_partkey")))
    prefix = F.element_at(F.array(*map(F.lit, ("ST-", "DP-", "X-", "TST-"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    kind = codes.bundle_type(F.concat(prefix, F.col("p_partkey")), F.when(F.col("p_size") > 40, F.concat_ws(" ", F.lit("set for"), "p_name")).otherwise(F.col("p_name")))
    return p.select("p_partkey", kind.alias("kind"), codes.bundle_billable(kind).alias("billable"), F.explode(codes.bundle_members(ref)).alias("member"))


def params_hashes(spark, d):
    return table(spark, d, "events").select("event_id", codes.params_hash(F.col("event_type"), F.col("user_id"), F.get_json_object("props", "$.k")).alias("params_hash"))


QUERIES = {
    "normalize_descriptions": normalised,
    "search_terms": terms,
    "normalize_product_type": product_types,
    "parse_currency": currencies,
    "ocr_numbers": recognised_numbers,
    "hs_slice": hs_levels,
    "reference_normalize": references,
    "rate_parse": rates,
    "bundle_expand": bundles,
    "params_hash": params_hashes,
}

_LIST = lambda values: "[" + ", ".join("'" + v + "'" for v in values) + "]"
_KEPT = lambda source, noise: f"list_filter(string_split_regex({source}, '\\s+'), lambda w: length(w) > 1 AND NOT list_contains({_LIST(noise)}, lower(w)))"
_FOLD = f"translate(regexp_replace(text, '[\\x{{0300}}-\\x{{036f}}]', '', 'g'), '{text._ACCENTED}', '{text._PLAIN}')"
_BARE = lambda source: f"regexp_replace(lower({source}), '[^a-z0-9\\s]', ' ', 'g')"
_ASSESSED = f"array_to_string({_KEPT(_BARE('text'), text.ASSESSED_NOISE)}, ' ')"
_FIRST = lambda values: "coalesce(" + ", ".join(f"CASE WHEN contains(lower(text), '{v}') THEN '{v}' END" for v in values) + ")"
_TERMS_SQL = f"array_to_string(list_slice({_KEPT(chr(39).join(['regexp_replace(text, ', '[^\\p{L}\\p{M}\\p{N}_\\s]', ', ', ' ', ', ', 'g', ')']), text.SEARCH_NOISE)}, 1, 5), ' ')"

SQL = {
    "normalize_descriptions": f"""
        WITH k AS (SELECT doc_id, array_to_string({_KEPT("regexp_replace(regexp_replace(lower(trim(text)), '[^\\p{L}\\p{M}\\p{N}_\\s]', ' ', 'g'), '(^|[\\s])[0-9]+([\\s]+[0-9]+)*($|[\\s])', ' ', 'g')", text.HISTORY_NOISE)}, ' ') AS h,
                   {_ASSESSED} AS a, array_to_string({_KEPT(_BARE(_FOLD), text.ASSESSED_NOISE)}, ' ') AS e FROM documents)
        SELECT doc_id, sha256(h) AS history_key, sha256(a) AS assessed_key, sha256(e) AS extract_key,
               length(a) >= 4 AND NOT regexp_matches(replace(a, ' ', ''), '^[0-9]+$') AND NOT list_contains({_LIST(text.GENERIC)}, a)
               AND (len(list_filter(string_split(a, ' '), lambda w: w <> '')) >= 2 OR length(a) >= 6) AS "specific" FROM k""",
    "search_terms": f"""
        WITH k AS (SELECT doc_id, {_TERMS_SQL} AS terms, concat_ws(' ', {_FIRST(text.DEMOGRAPHICS)}, {_FIRST(text.MATERIALS)}, {_FIRST(text.PRODUCTS)}) AS found,
                   sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS rule_text FROM documents)
        SELECT doc_id, terms, CASE WHEN found = '' THEN terms ELSE found END AS simplified, rule_text FROM k""",
    "normalize_product_type": r"""
        WITH t AS (SELECT p_partkey, p_name, upper(p_name || ' ' || p_type) AS u, p_type FROM part)
        SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(u, '\b(BLACK|WHITE|RED|BLUE|GREEN|YELLOW|GREY|GRAY|BROWN|PINK|PURPLE|ORANGE)\b', ' ', 'g'), '[^A-Z ]', ' ', 'g'), '\s+', ' ', 'g')) AS product_type,
               p_name || ' range' AS label FROM t""",
    "parse_currency": """
        SELECT c_custkey, CAST(CASE WHEN c_custkey % 6 = 2 THEN CASE WHEN c_acctbal < 0 THEN abs(c_acctbal) ELSE -c_acctbal END
                                    WHEN c_custkey % 6 = 3 THEN CASE WHEN c_acctbal < 0 THEN abs(c_acctbal) ELSE -c_acctbal END
                                    ELSE c_acctbal END AS DECIMAL(18,4)) AS amount FROM customer""",
    "ocr_numbers": """
        WITH c AS (SELECT o_orderkey, o_orderkey % 5 AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS s FROM orders),
             n AS (SELECT *, length(s) - length(replace(replace(s, '1', ''), '5', '')) AS swapped FROM c)
        SELECT o_orderkey, CAST(CASE WHEN k IN (0, 2, 3) THEN CAST(s AS DECIMAL(18,4)) WHEN k = 1 AND swapped <= 3 THEN CAST(s AS DECIMAL(18,4)) END AS DECIMAL(18,4)) AS value,
               CAST(CASE WHEN k = 0 THEN CAST(replace(s, '.', '') AS DECIMAL(18,4)) WHEN k = 1 AND swapped = 0 THEN CAST(s AS DECIMAL(18,4)) WHEN k = 2 THEN CAST(s AS DECIMAL(18,4)) ELSE 0 END AS DECIMAL(18,4)) AS price FROM n""",
    "hs_slice": """
        WITH c AS (SELECT p_partkey, lpad(CAST((p_partkey % 40) * 2300017 + 1010000 AS VARCHAR), 8, '0') AS code FROM part)
        SELECT p_partkey, code, left(code, 2) AS chapter, left(code, 4) AS heading, left(code, 6) AS subheading, code AS leaf, true AS is_leaf,
               CAST(left(code, 2) AS INT) BETWEEN 1 AND 97 AND left(code, 2) <> '77' AS chapter_ok FROM c""",
    "reference_normalize": """
        SELECT s_suppkey, 'AB' || s_suppkey || 'X' AS sku, CASE WHEN s_suppkey = 0 THEN 'INV000' ELSE CAST(s_suppkey AS VARCHAR) END AS ref, 'INV000' AS empty_ref, 'INV' || s_suppkey AS file_ref,
               CASE WHEN s_suppkey % 4 < 3 THEN strftime(DATE '2024-01-01' + CAST(s_suppkey % 366 AS INT), '%Y-%m-%d') END AS "day" FROM supplier""",
    "rate_parse": """
        SELECT p_partkey, CAST(CASE p_partkey % 8 WHEN 0 THEN 0.0 WHEN 2 THEN 0.05 WHEN 3 THEN 0.2 WHEN 4 THEN 0.2 WHEN 5 THEN 0.0 END AS DOUBLE) AS rate FROM part""",
    "bundle_expand": """
        WITH p AS (SELECT *, p_partkey % 7 + 1 AS a, p_partkey % 9 + 1 AS b FROM part),
             k AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'starter_kit' WHEN 1 THEN 'display' WHEN 3 THEN 'tester_set' ELSE CASE WHEN p_size > 40 THEN 'set' END END AS kind FROM p),
             m AS (SELECT *, CASE WHEN p_partkey % 10 = 0 AND a <= b THEN list_transform(range(a, b + 1), lambda x: 'MF' || lpad(CAST(x AS VARCHAR), 2, '0'))
                                  WHEN p_partkey % 10 = 0 THEN ['MF0' || a || '-0' || b || '*'] ELSE ['BASE' || p_partkey || '*'] END AS members FROM k)
        SELECT p_partkey, kind, coalesce(kind NOT IN ('starter_kit', 'set'), true) AS billable, unnest(members) AS member FROM m""",
    "params_hash": """
        SELECT event_id, sha256(event_type || chr(31) || user_id || chr(31) || coalesce(json_extract_string(props, '$.k'), '\\N')) AS params_hash FROM events""",
}

"""Classification queries over parts: names are descriptions, codes are made from names and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.functions.text import assessed_key
from tradeloom.operators import classification as C
from tradeloom.sources.shared import kept
from tradeloom.sources.tables import table, tariff_code

#: seq, id, code, category, patterns, exclude, priority, confidence
RULES = [
    (1, "r-bolt", "73181500", "BOLTS", ["bolt"], ["blue"], 10, 0.90),
    (2, "r-red", "39269000", "RED GOODS", ["red"], [], 10, 0.80),
    (3, "r-widget", "84799000", "WIDGETS", ["widget"], ["small economy"], 20, 0.85),
    (4, "r-anvil", "82059000", "ANVILS", ["anvil", "forge"], [], 5, 0.95),
    (5, "r-promo", "49111000", "PROMOTION", ["promo ring", "ring promo"], [], 30, 0.70),
    (6, "r-ol", "15099000", "OILS", ["ol"], [], 40, 0.60),
]
#: seq, code, category, keywords, materials, items
CATEGORIES = [
    (1, "83024900", "FITTINGS", ["small", "plate"], ["metal"], ["bolt"]),
    (2, "72159000", "RODS", ["rod", "large"], ["steel"], ["rod"]),
    (3, "71179000", "RINGS", ["ring"], [], ["ring", "hot"]),
]
BRANDS = [(1, "cold", "84189900"), (2, "gear", "84839000"), (3, "gizmo", "95030000")]
INVALID = [("01010000", "03310017"), ("12510085", "99999999"), ("17110119", "17110100"), ("40200200", "40200209"), ("86610600", "86610601"), ("33610290", "33610299")]
#: Every code but those of the residues 3, 7 and 12 modulo 40 is valid; 17110190 and 40200290 are added.
NOT_VALID = (3, 7, 12)
ADDED = ("17110190", "40200290", "33610200", "33610290", "86610600", "79109900")


def _dim(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def rules(spark):
    return _dim(spark, RULES, "seq int, id string, code string, category string, patterns array<string>, exclude array<string>, priority int, confidence double")


def categories(spark):
    return _dim(spark, CATEGORIES, "seq int, code string, category string, keywords array<string>, materials array<string>, items array<string>")


def valid_codes(spark, d):
    made = table(spark, d, "part").filter(~(F.col("p_partkey") % 40).isin(*NOT_VALID)).select(tariff_code("p_partkey").alias("code")).distinct()
    return made.unionByName(_dim(spark, [(c,) for c in ADDED], "code string")).distinct()


def invalid_codes(spark):
    return _dim(spark, INVALID, "code string, correct_code string")


def part_keys(spark, d):
    """Distinct descriptions of parts."""
    return table(spark, d, "part").select(assessed_key(F.concat_ws(" ", "p_name", "p_type")).alias("key")).distinct()


def assessed(spark, d):
    """An assessed dimension by majority over parts: a name's own code, but every seventh part has another."""
    p = table(spark, d, "part")
    own = F.lpad(((F.length("p_name") * 5000011 + F.ascii("p_name") * 70001) % 97000000 + 1000000).cast("string"), 8, "0")
    rows = p.select(
        assessed_key(F.concat_ws(" ", F.when(F.col("p_partkey") % 9 == 0, F.col("p_partkey") % 37 + 10), F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", "p_name", "p_type")).otherwise(F.col("p_name")))).alias("description_norm"),
        F.when(F.col("p_partkey") % 7 == 0, tariff_code("p_partkey")).otherwise(own).alias("code"), "p_brand", "p_name", F.concat(F.lit("db"), F.col("p_size") % 3).alias("source"),
    )
    return C.majority_vote(rows, "description_norm", "code", valid_codes(spark, d), "p_brand", "source", "p_name").withColumn("seq", F.xxhash64("description_norm"))


def majority(spark, d):
    return assessed(spark, d).select("description_norm", "code", "count", "total", "confidence", "sample", F.array_join("sources", ",").alias("sources"), F.array_join("refs", ",").alias("refs"))


def _ordered(spark, d):
    """Entries in the order of their key (a name is its place), computed once."""
    return kept(assessed(spark, d).withColumn("seq", F.col("description_norm")), "assessed")


def _tier(tier):
    def query(spark, d):
        return _score(tier(part_keys(spark, d), _ordered(spark, d)))

    return query


def _score(df):
    return df.select("key", "code", F.round(F.col("score").cast("decimal(18,8)"), 4).cast("double").alias("score"), "tier")


def lookup(spark, d):
    keys = part_keys(spark, d)
    chapters = keys.filter(F.length("key") % 3 == 0).select("key", F.lit("46").alias("chapter"))
    return _score(C.assessed_lookup(keys, _ordered(spark, d), chapters, valid=valid_codes(spark, d), invalid=invalid_codes(spark)))


def cross(spark, d):
    e = _ordered(spark, d)
    found = C.assessed_containment(part_keys(spark, d), e).select("key", F.when(F.length("key") % 2 == 0, F.lit("99999999")).otherwise(F.col("code")).alias("code"), "seq")
    return C.cross_validated(found, e).drop("seq")


def rules_v1(spark, d):
    keys = part_keys(spark, d)
    chapters = keys.filter(F.col("key").endswith("standard")).select("key", F.lit("39").alias("chapter"))
    return C.rule_match(keys, rules(spark), chapters=chapters)


def rules_v2(spark, d):
    return C.rule_match(part_keys(spark, d), rules(spark), boundary=0)


def category(spark, d):
    return C.category_scores(part_keys(spark, d), categories(spark))


def brand(spark, d):
    return C.contained_value(part_keys(spark, d), _dim(spark, BRANDS, "seq int, brand string, code string"))


def correction(spark, d):
    rows = table(spark, d, "part").select("p_partkey", tariff_code("p_partkey").alias("code"))
    return C.corrected(rows, valid_codes(spark, d), invalid_codes(spark))


def _tree(spark):
    """A small code tree: leaves, general leaves, headings and chapters; rates are missing at some."""
    rows = [("33100170", "Fittings", None), ("40200290", "Other", 0.1), ("40200000", "Rubber parts", 0.15), ("01000000", "Animals", 0.0), ("90000000", "Instruments", 0.3), ("54020000", "Yarn", None), ("54000000", "Filaments", 0.05), ("33000000", "Oils", 0.2)]
    return _dim(spark, rows, "code string, description string, rate double")


def _tree_rows(spark, d):
    k = F.col("p_partkey")
    code = F.when(k % 5 == 0, F.lit("40200290")).when(k % 5 == 1, F.lit("33100170")).when(k % 5 == 2, F.lit("54021234")).otherwise(tariff_code("p_partkey"))
    return table(spark, d, "part").select("p_partkey", code.alias("code"))


def labels(spark, d):
    return C.category_label(_tree_rows(spark, d), _tree(spark))


def duty_rates(spark, d):
    out = C.walked_up(_tree_rows(spark, d), _tree(spark), "rate")
    return out.withColumn("rate", F.coalesce("rate", F.lit(0.20)))


def code_gate(spark, d):
    from tradeloom.functions import codes

    rows = table(spark, d, "part").select("p_partkey", tariff_code("p_partkey").alias("code"))
    bad = invalid_codes(spark)
    ok = rows.filter(codes.chapter_ok(F.col("code")))
    return ok.join(C.dimension(bad), "code", "left_anti").join(C.dimension(valid_codes(spark, d)), "code", "left_semi").select("p_partkey", "code")


def fanout(spark, d):
    """Items classified by rule, each distinct description once."""
    from tradeloom.operators.common import fanned_out
    from tradeloom.sources.tables import invoice_items

    items = invoice_items(spark, d).select("invoice_id", "line", "part_id", "total_cost", "description")
    found = fanned_out(items, assessed_key(F.col("description")), lambda keys: C.rule_match(keys, rules(spark)))
    return found.groupBy(F.coalesce("code", F.lit("UNKNOWN")).alias("code")).agg(F.count("*").alias("n"), F.sum("total_cost").cast("decimal(18,2)").alias("cost"))


QUERIES = {
    "majority_vote": majority,
    "assessed_exact": _tier(C.assessed_exact),
    "assessed_containment": _tier(C.assessed_containment),
    "assessed_token_overlap": _tier(C.assessed_overlap),
    "assessed_lookup": lookup,
    "chapter_cross_validate": cross,
    "rule_match_v1": rules_v1,
    "rule_match_v2": rules_v2,
    "category_keyword_score": category,
    "brand_lookup": brand,
    "code_validate_correct": correction,
    "category_walkup": labels,
    "rate_walkup": duty_rates,
    "hs_code_gate": code_gate,
    "batch_dedup_fanout": fanout,
}

_NOISE = "('the','a','an','and','or','for','with','in','on','to','of','no','nr','num','pcs','pc','ea','each','qty','quantity','size','color','colour','pack','set','pieces','item','items','new','used','unit','units','assorted','various','other')"
_KEY = lambda x: f"array_to_string(list_filter(string_split(lower({x}), ' '), lambda w: length(w) > 1 AND w NOT IN {_NOISE}), ' ')"
_CODE = "lpad(CAST((p_partkey % 40) * 2300017 + 1010000 AS VARCHAR), 8, '0')"
_VALID = f"valid AS (SELECT DISTINCT {_CODE} AS code FROM part WHERE p_partkey % 40 NOT IN {NOT_VALID} UNION SELECT * FROM (VALUES ('17110190'), ('40200290'), ('33610200'), ('33610290'), ('86610600'), ('79109900')))"
_BAD = "bad AS (SELECT * FROM (VALUES ('01010000','03310017'), ('12510085','99999999'), ('17110119','17110100'), ('40200200','40200209'), ('86610600','86610601'), ('33610290','33610299')) t(code, correct_code))"
#: The rules in order: listed, valid, with 00, by subheading, by heading, itself.
_FIX = lambda c: f"""CASE WHEN {c} IN (SELECT code FROM bad) THEN (SELECT correct_code FROM bad WHERE bad.code = {c}) WHEN {c} IN (SELECT code FROM valid) THEN {c}
  WHEN left({c}, 6) || '00' IN (SELECT code FROM valid) THEN coalesce((SELECT correct_code FROM bad WHERE bad.code = left({c}, 6) || '00'), left({c}, 6) || '00')
  ELSE coalesce((SELECT max(v.code) FROM valid v WHERE left(v.code, 6) = left({c}, 6) AND right(v.code, 2) = '90' AND v.code NOT IN (SELECT code FROM bad)),
                (SELECT max(v.code) FROM valid v WHERE left(v.code, 6) = left({c}, 6) AND v.code NOT IN (SELECT code FROM bad)),
                (SELECT max(v.code) FROM valid v WHERE left(v.code, 4) = left({c}, 4) AND right(v.code, 2) IN ('90', '00') AND v.code NOT IN (SELECT code FROM bad)),
                (SELECT max(v.code) FROM valid v WHERE left(v.code, 4) = left({c}, 4) AND v.code NOT IN (SELECT code FROM bad)), {c}) END"""  # noqa: E731
_KEYS = f"ks AS (SELECT DISTINCT {_KEY(chr(39).join(['p_name || ', ' ', ' || p_type']))} AS key FROM part)"
_ASSESSED = f"""{_VALID}, src AS (
  SELECT {_KEY("CASE WHEN p_partkey % 9 = 0 THEN (p_partkey % 37 + 10) || ' ' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' || p_type ELSE p_name END")} AS description_norm, p_name, p_brand, 'db' || p_size % 3 AS source,
         CASE WHEN p_partkey % 7 = 0 THEN {_CODE} ELSE lpad(CAST((length(p_name) * 5000011 + ascii(p_name) * 70001) % 97000000 + 1000000 AS VARCHAR), 8, '0') END AS code FROM part),
votes AS (SELECT description_norm, code, count(*) AS n FROM src GROUP BY ALL),
pick AS (SELECT *, row_number() OVER (PARTITION BY description_norm ORDER BY n DESC, code NOT IN (SELECT code FROM valid), code) AS r, sum(n) OVER (PARTITION BY description_norm) AS total FROM votes),
extra AS (SELECT description_norm, max_by(p_name, (length(p_name), p_name)) AS sample, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources,
          array_to_string(list_slice(list_sort(list_distinct(list(p_brand))), 1, 10), ',') AS refs FROM src GROUP BY 1),
assessed AS (SELECT description_norm, code, n AS count, CAST(total AS BIGINT) AS total, CAST(round(CAST(n / total AS DECIMAL(18,6)), 3) AS DOUBLE) AS confidence, sample, sources, refs
             FROM pick JOIN extra USING (description_norm) WHERE r = 1)"""
_TIER1 = "t1 AS (SELECT key, code, least(0.97, 0.90 + 0.07 * confidence) AS score, 'exact' AS tier, key AS entry FROM ks JOIN assessed ON key = description_norm WHERE confidence >= 0.60 AND count >= 2)"
_TIER2 = """p2 AS (SELECT key, code, confidence, description_norm, least(length(key), length(description_norm)) / greatest(length(key), length(description_norm)) AS cov FROM ks, assessed
  WHERE (contains(key, description_norm) OR contains(description_norm, key)) AND contains(key, ' ') AND contains(description_norm, ' ') AND least(length(key), length(description_norm)) >= 12),
t2 AS (SELECT key, code, least(0.92, 0.85 + 0.07 * confidence) AS score, 'containment' AS tier, description_norm AS entry FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cov DESC, description_norm) AS r FROM p2 WHERE cov >= 0.40) WHERE r = 1)"""
_TIER3 = """w AS (SELECT key, list_distinct(string_split(key, ' ')) AS a FROM ks), v AS (SELECT *, list_distinct(string_split(description_norm, ' ')) AS b FROM assessed WHERE confidence >= 0.85 AND count >= 5),
p3 AS (SELECT key, code, description_norm, len(list_intersect(a, b)) AS c, (len(list_intersect(a, b)) / len(a) + len(list_intersect(a, b)) / len(b)) / 2 AS share FROM w, v WHERE len(a) >= 3),
t3 AS (SELECT key, code, least(0.85, 0.75 + 0.10 * share) AS score, 'overlap' AS tier, description_norm AS entry FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY share DESC, description_norm) AS r FROM p3 WHERE c >= 3 AND share > 0.75) WHERE r = 1)"""
_CROSS = """matched AS (SELECT cand.*, a.count AS own, string_split(a.refs, ',') AS refs FROM cand JOIN assessed a ON a.description_norm = cand.entry),
rival AS (SELECT left(code, 2) AS chapter, count, string_split(refs, ',') AS refs FROM assessed WHERE regexp_matches(description_norm, '^[0-9]')),
asked AS (SELECT key, list_distinct(string_split(key, ' ')) AS a FROM (SELECT DISTINCT key FROM cand)),
sib AS (SELECT asked.key, left(s.code, 2) AS chapter, sum(s.count) AS weight, min(s.description_norm) AS first FROM asked, assessed s
        WHERE len(a) >= 2 AND len(list_distinct(string_split(s.description_norm, ' '))) >= 2 AND len(list_intersect(a, string_split(s.description_norm, ' '))) >= greatest(2.0, 0.75 * len(a)) GROUP BY ALL),
led AS (SELECT key, chapter, sum(weight) OVER (PARTITION BY key) AS total, row_number() OVER (PARTITION BY key ORDER BY weight DESC, first) AS r FROM sib),
stands AS (SELECT m.* FROM matched m LEFT JOIN sib ON sib.key = m.key AND sib.chapter = left(m.code, 2) LEFT JOIN led ON led.key = m.key AND led.r = 1
           WHERE NOT EXISTS (SELECT 1 FROM rival WHERE list_has_any(rival.refs, m.refs) AND rival.chapter <> left(m.code, 2) AND rival.count >= m.own)
             AND (led.chapter IS NULL OR led.chapter = left(m.code, 2) OR coalesce(sib.weight, 0) >= 0.30 * led.total))"""
_SCORE = "CAST(round(CAST(score AS DECIMAL(18,8)), 4) AS DOUBLE) AS score"
_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"({s}, '{i}', '{c}', '{k}', {p}, {e or '[]::VARCHAR[]'}, {q}, {f}::DOUBLE)" for s, i, c, k, p, e, q, f in RULES) + ") t(seq, id, code, category, patterns, exclude, priority, confidence))"
_RULE_PAIRS = "pairs AS (SELECT key, id AS rule_id, code, category, confidence, priority, seq FROM ks, rules WHERE len(list_filter(exclude, lambda p: contains(key, p))) = 0 AND len(list_filter(patterns, lambda p: {test})) > 0)"
_FIRST_RULE = "SELECT key, rule_id, code, category, confidence FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY priority DESC, seq) AS r FROM pairs WHERE {gate}) WHERE r = 1"
_BOUNDED = "CASE WHEN length(p) < 7 THEN regexp_matches(key, '\\b' || p || '\\b') ELSE contains(key, p) END"
_TREE_SQL = """tree AS (SELECT * FROM (VALUES ('33100170','Fittings',NULL), ('40200290','Other',0.1), ('40200000','Rubber parts',0.15), ('01000000','Animals',0.0), ('90000000','Instruments',0.3),
  ('54020000','Yarn',NULL), ('54000000','Filaments',0.05), ('33000000','Oils',0.2)) t(code, description, rate)),
rows AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '40200290' WHEN 1 THEN '33100170' WHEN 2 THEN '54021234' ELSE """ + _CODE + """ END AS code FROM part)"""  # fmt: skip
_UP = lambda alias, n, cond: f"LEFT JOIN tree {alias} ON {alias}.code = rpad(left(r.code, {n}), 8, '0') AND {cond.format(a=alias)}"
_UPS = lambda cond: " ".join(_UP(f"t{n}", n, cond) for n in (8, 6, 4, 2))

SQL = {
    "majority_vote": f"WITH {_ASSESSED} SELECT * FROM assessed",
    "assessed_exact": f"WITH {_ASSESSED}, {_KEYS}, {_TIER1} SELECT key, code, {_SCORE}, tier FROM t1",
    "assessed_containment": f"WITH {_ASSESSED}, {_KEYS}, {_TIER2} SELECT key, code, {_SCORE}, tier FROM t2",
    "assessed_token_overlap": f"WITH {_ASSESSED}, {_KEYS}, {_TIER3} SELECT key, code, {_SCORE}, tier FROM t3",
    "assessed_lookup": f"""WITH {_ASSESSED}, {_BAD}, {_KEYS}, {_TIER1}, {_TIER2}, {_TIER3},
        tiers AS (SELECT *, 1 AS n FROM t1 UNION ALL SELECT *, 2 FROM t2 UNION ALL SELECT *, 3 FROM t3),
        cand AS (SELECT * REPLACE ({_FIX("tiers.code")} AS code) FROM tiers), {_CROSS}
        SELECT key, code, {_SCORE}, tier FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n) AS r FROM stands WHERE length(key) % 3 <> 0 OR left(code, 2) = '46') WHERE r = 1""",
    "chapter_cross_validate": f"""WITH {_ASSESSED}, {_KEYS}, {_TIER2},
        cand AS (SELECT key, CASE WHEN length(key) % 2 = 0 THEN '99999999' ELSE code END AS code, entry FROM t2), {_CROSS}
        SELECT key, code FROM stands""",
    "rule_match_v1": f"WITH {_KEYS}, {_RULES}, {_RULE_PAIRS.format(test=_BOUNDED)} " + _FIRST_RULE.format(gate="(NOT ends_with(key, 'standard') OR left(code, 2) = '39')"),
    "rule_match_v2": f"WITH {_KEYS}, {_RULES}, {_RULE_PAIRS.format(test='contains(key, p)')} {_FIRST_RULE.format(gate='true')}",
    "category_keyword_score": f"""WITH {_KEYS}, cats AS (SELECT * FROM (VALUES {", ".join(f"({s}, '{c}', '{n}', {k}, {m or '[]::VARCHAR[]'}, {i})" for s, c, n, k, m, i in CATEGORIES)}) t(seq, code, category, kw, mat, it)),
        s AS (SELECT key, code, category, seq, len(list_filter(kw, lambda x: contains(key, x))) + 2 * len(list_filter(mat, lambda x: contains(key, x))) + 2 * len(list_filter(it, lambda x: contains(key, x))) AS points FROM ks, cats)
        SELECT key, code, category, CAST(points AS INT) AS points, CAST(least(0.75, 0.5 + 0.05 * points) AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY points DESC, seq) AS r FROM s WHERE points >= 2) WHERE r = 1""",
    "brand_lookup": f"""WITH {_KEYS}, b AS (SELECT * FROM (VALUES (1, 'cold', '84189900'), (2, 'gear', '84839000'), (3, 'gizmo', '95030000')) t(seq, brand, code))
        SELECT key, brand, code, CAST(0.7 AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS r FROM ks, b WHERE contains(key, brand)) WHERE r = 1""",
    "code_validate_correct": f"""WITH {_VALID}, {_BAD}, rows AS (SELECT p_partkey, {_CODE} AS code FROM part), x AS (SELECT *, left(code, 6) || '00' AS zero FROM rows)
        SELECT p_partkey, code, {_FIX("x.code")} AS corrected,
               CASE WHEN code IN (SELECT code FROM bad) THEN 'mapped' WHEN code IN (SELECT code FROM valid) THEN 'valid'
                    WHEN zero IN (SELECT code FROM valid) THEN CASE WHEN zero IN (SELECT code FROM bad) THEN 'zero mapped' ELSE 'zero' END
                    WHEN EXISTS (SELECT 1 FROM valid v WHERE left(v.code, 6) = left(x.code, 6) AND v.code NOT IN (SELECT code FROM bad)) THEN 'subheading'
                    WHEN EXISTS (SELECT 1 FROM valid v WHERE left(v.code, 4) = left(x.code, 4) AND v.code NOT IN (SELECT code FROM bad)) THEN 'heading' ELSE 'none' END AS how FROM x""",
    "category_walkup": f"""WITH {_TREE_SQL}, u AS (SELECT r.p_partkey, r.code, l.description AS leaf, coalesce(t8.description, t6.description, t4.description, t2.description) AS up,
            CASE WHEN t8.code IS NOT NULL THEN 8 WHEN t6.code IS NOT NULL THEN 6 WHEN t4.code IS NOT NULL THEN 4 WHEN t2.code IS NOT NULL THEN 2 END AS level
            FROM rows r LEFT JOIN tree l ON l.code = r.code {_UPS("lower({a}.description) <> $$other$$")})
        SELECT p_partkey, code, CASE WHEN lower(leaf) = 'other' AND NOT upper(up) LIKE 'OTHER%' THEN 'Other ' || up ELSE up END AS category, level FROM u""",
    "rate_walkup": f"""WITH {_TREE_SQL} SELECT r.p_partkey, r.code, CAST(coalesce(t8.rate, t6.rate, t4.rate, t2.rate, 0.20) AS DOUBLE) AS rate,
            CASE WHEN t8.code IS NOT NULL THEN 8 WHEN t6.code IS NOT NULL THEN 6 WHEN t4.code IS NOT NULL THEN 4 WHEN t2.code IS NOT NULL THEN 2 END AS level FROM rows r {_UPS("{a}.rate IS NOT NULL")}""",
    "hs_code_gate": f"""WITH {_VALID} SELECT p_partkey, {_CODE} AS code FROM part WHERE CAST(left({_CODE}, 2) AS INT) BETWEEN 1 AND 97 AND left({_CODE}, 2) <> '77'
        AND {_CODE} NOT IN ('01010000', '12510085', '17110119', '40200200', '86610600', '33610290') AND {_CODE} IN (SELECT code FROM valid)""",
    "batch_dedup_fanout": f"""WITH items AS (SELECT {_KEY("p_name || ' ' || lower(p_type) || ' size ' || p_size")} AS key, CAST(l_extendedprice AS DECIMAL(18,2)) AS total_cost FROM lineitem JOIN part ON l_partkey = p_partkey),
        ks AS (SELECT DISTINCT key FROM items), {_RULES}, {_RULE_PAIRS.format(test=_BOUNDED)}, hit AS ({_FIRST_RULE.format(gate="true")})
        SELECT coalesce(code, 'UNKNOWN') AS code, count(*) AS n, CAST(sum(total_cost) AS DECIMAL(18,2)) AS cost FROM items LEFT JOIN hit USING (key) GROUP BY 1""",
}

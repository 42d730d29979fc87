"""Rules and edge rows of single operators."""

from __future__ import annotations

import math
import random
from decimal import Decimal
from itertools import product

import pytest
from pyspark.sql import functions as F

from tradeloom.functions import codes, money, text
from tradeloom.operators import classification as C
from tradeloom.operators import documents as D
from tradeloom.operators import history as H
from tradeloom.operators import matching as M
from tradeloom.operators import ordering as O
from tradeloom.operators import quality as Q
from tradeloom.operators import reconcile as R
from tradeloom.operators.common import dimension, fanned_out


def column(spark, values, f, ddl="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], ddl).select(f(F.col("v"))).collect()]


def test_currency(spark):
    got = column(spark, ["$1,234.56", "(50.00)", "-$5", "", None, "abc", "€ 7", "1.2.3", "(abc)", ".5"], money.currency)
    assert got == list(map(Decimal, ["1234.56", "-50", "-5", "0", "0", "0", "7", "0", "0", "0.5"]))


def test_recognised_numbers(spark):
    cases = {"7/.12": "71.12", "1l9.96": "119.96", "18 02": "18.02", "84,48": "84.48", "1,234": "1234", "1,234.50": "1234.5", "$5.00;": "5", "OOOO": None, "OOO": "0", "x1": None, "": None, None: None, "1·5": "1.5", "12345678901234567": None}
    got = column(spark, list(cases), money.recognised)
    assert got == [None if v is None else Decimal(v) for v in cases.values()]


def test_rounding_is_half_up(spark):
    assert column(spark, [0.125, 1.005, 2.675], money.rounded, "v double") == [Decimal("0.13"), Decimal("1.01"), Decimal("2.68")]


def test_duties(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in money.duties(F.lit(Decimal("100.00")), F.lit(0.2)).items()]).first()
    assert (row.cif_local, row.customs, row.service, row.vat, row.duties) == tuple(map(Decimal, ("271.69", "54.34", "16.30", "51.35", "121.99")))
    back = spark.range(1).select(money.value_behind(F.lit(121.99), F.lit(0.2), F.lit(0.0), F.lit(0.0))).first()[0]
    assert abs(back - 100) < Decimal("0.05")


def test_keys(spark):
    assert column(spark, ["The NEW 12 Café-Chairs, set of 4!", None, ""], text.history_key) == ["new café chairs set", "", ""]
    assert column(spark, ["The NEW 12 Café-Chairs, set of 4!"], text.assessed_key) == ["12 caf chairs"]
    assert column(spark, ["The NEW 12 Café-Chairs, set of 4!", "Café"], text.extract_key) == ["12 cafe chairs", "cafe"]
    assert column(spark, ["One the two of three four five six seven"], text.search_terms) == ["One two three four five"]
    assert column(spark, ["Kids' Steel Bottle", "plain words here"], text.simplified) == ["kids steel bottle", "plain words here"]
    assert column(spark, ["abc", "12345", "goods", "widget", "two words", "bolts"], text.specific_enough) == [False, False, False, True, True, False]


def test_codes(spark):
    assert column(spark, ["Free", "A", "0-5%", "20", "0.2", None, "5-x%"], codes.rate) == [0.0, None, 0.05, 0.2, 0.2, None, None]
    assert column(spark, ["INV0012", "INV000", "X1"], codes.reference) == ["12", "INV000", "X1"]
    assert column(spark, ["MFHG01-04", "BASE", "MFHG04-01"], codes.bundle_members) == [["MFHG01", "MFHG02", "MFHG03", "MFHG04"], ["BASE*"], ["MFHG04-01*"]]
    assert column(spark, ["01010000", "77010000", "99010000", "1234", None], codes.chapter_ok) == [True, False, False, False, False]
    pairs = spark.createDataFrame([("", None), ("12345678", "12345678"), ("12345678", "12345600"), ("12345678", "12340000"), ("12345678", "")], "a string, b string")
    assert [r[0] for r in pairs.select(codes.match_status(F.col("a"), F.col("b"))).collect()] == ["exact_match", "exact_match", "subheading_match", "heading_match", "disagree"]


RULES = "seq int, id string, code string, category string, patterns array<string>, exclude array<string>, priority int, confidence double"


def test_rules(spark):
    rules = spark.createDataFrame(
        [(1, "a", "11000000", "A", ["tape"], [], 5, 0.9), (2, "b", "22000000", "B", ["tape"], [], 5, 0.9), (3, "c", "33000000", "C", ["adhesive"], ["no glue"], 9, 0.9), (4, "d", "44000000", "D", ["c++"], [], 1, 0.5)], RULES
    )
    keys = spark.createDataFrame([("tape roll",), ("tapes",), ("adhesives",), ("adhesives no glue",), ("c++ book",)], "key string")
    found = {r.key: r.rule_id for r in C.rule_match(keys, rules).collect()}
    assert found == {"tape roll": "a", "adhesives": "c"}  # short patterns are whole words, ties keep the list's order
    assert {r.key: r.rule_id for r in C.rule_match(keys, rules, boundary=0).collect()} == {"tape roll": "a", "tapes": "a", "adhesives": "c", "c++ book": "d"}
    chapters = spark.createDataFrame([("tape roll", "22")], "key string, chapter string")
    assert {r.key: r.rule_id for r in C.rule_match(keys, rules, chapters=chapters).collect()}["tape roll"] == "b"  # a gated rule doesn't end the search


def test_majority(spark):
    rows = [("k", "1", "r1", "s", "aa")] * 2 + [("k", "2", "r2", "s", "aaa")] * 2 + [("k", "3", "r3", "t", "a")]
    valid = spark.createDataFrame([("2",)], "code string")
    r = C.majority_vote(spark.createDataFrame(rows, "key string, code string, ref string, source string, text string"), "key", "code", valid, "ref", "source", "text").first()
    assert (r.code, r["count"], r.total, r.confidence, r.sample, r.sources, r.refs) == ("2", 2, 5, 0.4, "aaa", ["s", "t"], ["r1", "r2", "r3"])


def test_correction(spark):
    valid = spark.createDataFrame([(c,) for c in ("11111100", "22222290", "22222295", "33330001", "55550000", "55550042", "66666600", "77777790", "77777710")], "code string")
    bad = spark.createDataFrame([("99999999", "nowhere"), ("66666600", "66666601"), ("77777790", "x")], "code string, correct_code string")
    rows = spark.createDataFrame([(c,) for c in ("99999999", "11111100", "11111155", "22222211", "33335555", "44444444", "55559999", "66666677", "77777755", "UNKNOWN", None)], "code string")
    got = {r.code: (r.corrected, r.how) for r in C.corrected(rows, valid, bad).collect()}
    assert got == {
        "99999999": ("nowhere", "mapped"), "11111100": ("11111100", "valid"), "11111155": ("11111100", "zero"), "22222211": ("22222290", "subheading"), "33335555": ("33330001", "heading"),
        "44444444": ("44444444", "none"), "55559999": ("55550000", "heading"), "66666677": ("66666601", "zero mapped"), "77777755": ("77777710", "subheading"), "UNKNOWN": ("UNKNOWN", "none"), None: (None, "none"),
    }


ENTRIES = "seq int, description_norm string, code string, confidence double, count int, refs array<string>"


def test_containment_is_of_text(spark):
    """Within words, too; the score is by the entry's confidence, and the largest share of the longer text wins."""
    e = spark.createDataFrame([(1, "ball pointer pen", "11", 0.5, 9, []), (2, "pen ball pointer", "22", 1.0, 9, []), (3, "pointer", "33", 1.0, 9, []), (4, "a football pointers", "44", 0.2, 9, [])], ENTRIES)
    keys = spark.createDataFrame([("football pointer penny",), ("football pointer",), ("oneword",), ("short it",)], "key string")
    got = {r.key: (r.code, round(r.score, 4)) for r in C.assessed_containment(keys, e).collect()}
    assert got == {"football pointer penny": ("11", 0.885), "football pointer": ("44", 0.864)}


def test_references_and_siblings_refute(spark):
    e = spark.createDataFrame([
        (1, "brass ship bell", "83000000", 0.9, 4, ["r1"]), (2, "12 brass bell", "74000000", 0.9, 4, ["r1", "r2"]), (3, "steel ship anchor", "73000000", 0.9, 4, ["r3"]), (4, "7 anchor", "89000000", 0.9, 3, ["r3"]),
        (5, "rope nylon white", "56000000", 0.9, 1, []), (6, "rope nylon white long", "39000000", 0.9, 9, []),
    ], ENTRIES)
    asked = [("brass ship bell", "83000000", 1), ("steel ship anchor", "73000000", 3), ("rope nylon white", "56000000", 5), ("rope nylon white", "39000000", 6)]
    got = {(r.key, r.code) for r in C.cross_validated(spark.createDataFrame(asked, "key string, code string, seq int"), e).collect()}
    assert got == {("steel ship anchor", "73000000"), ("rope nylon white", "39000000")}  # a rival of fewer entries doesn't refute


def test_tier_codes_are_corrected(spark):
    e = spark.createDataFrame([(1, "brass ship bell", "83000011", 0.9, 4, ["r1"])], ENTRIES)
    valid, bad = spark.createDataFrame([("83000000",)], "code string"), spark.createDataFrame([("1", "2")], "code string, correct_code string")
    keys = spark.createDataFrame([("brass ship bell",)], "key string")
    assert C.assessed_lookup(keys, e, valid=valid, invalid=bad).first().code == "83000000"
    assert C.assessed_lookup(keys, e).first().code == "83000011"


def test_rare_words_find_all_pairs(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("a b c d e f g h".split()) + rng.choice("1 2 3".split()) for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    e = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq int, description_norm string")
    keys = spark.createDataFrame([(t,) for t in set(texts)], "key string")
    for least, need in ((F.greatest(F.lit(2), F.ceil(F.col("n") * 0.75).cast("int")), lambda n: max(2, math.ceil(0.75 * n))), (F.lit(1), lambda n: 1)):
        got = {(r.key, r.seq, r.common) for r in C._by_rare_words(keys, e, least).collect()}
        assert got == {(k, i, c) for k in set(texts) for i, t in enumerate(texts) if (c := len(set(k.split()) & set(t.split()))) >= need(len(set(k.split())))}


def test_orders_by_reference(spark):
    inv = spark.createDataFrame([(1, "2026-001763"), (2, "1763"), (3, ""), (4, "ABC-1")], "invoice_id long, ref string")
    po = spark.createDataFrame([(10, ["2026001763-B"]), (11, ["x", "176"]), (12, ["ABC1-22", ""]), (13, [])], "order_id long, refs array<string>")
    got = {tuple(r) for r in M.po_candidates(inv, po).collect()}
    assert got == {(1, 10), (2, 10), (1, 11), (2, 11), (4, 12)}


def test_aliases_are_read_both_ways(spark):
    a = spark.createDataFrame([("a-1", "B 2", None), ("c3", None, "d-4")], "sku string, bm_code string, supplier_item string")
    assert {tuple(r) for r in M.alias_pairs(a).collect()} == {("A1", "B2"), ("B2", "A1"), ("C3", "D4"), ("D4", "C3")}


def test_officers_rows_take_ours_in_their_order(spark):
    ours = [(1, 1, "S1", "red bolt"), (1, 2, None, "blue bolt large"), (1, 3, "s2", "rope")]
    theirs = [(1, 1, "s2", "nothing"), (1, 2, None, "blue bolt huge"), (1, 3, None, "red bolt"), (1, 4, None, "rope"), (1, 5, None, "unlike all else")]
    ddl = "shipment_id long, seq int, sku string, description string"
    got = sorted((r.official_seq, r.seq, r.how) for r in M.officer_matched(spark.createDataFrame(ours, ddl), spark.createDataFrame(theirs, ddl)).collect())
    assert got == [(1, 3, "sku"), (2, 2, "words"), (3, 1, "description"), (4, 3, "description")]


def test_partition_of_many_ways():
    """Three declarations of thirteen items are all looked at; ties go to the first way."""
    rng = random.Random(5)
    for n, k in ((6, 3), (5, 4), (7, 2)):
        costs, targets = [float(rng.randrange(1, 9)) for _ in range(n)], [float(rng.randrange(4, 20)) for _ in range(k)]
        best = None
        for code in range(k**n):
            way = [code // k**i % k for i in range(n)]
            if k == 2:
                way = [1 - d for d in way]
            if len(set(way)) == k:
                score = O.deviation([sum(c for c, w in zip(costs, way, strict=True) if w == d) for d in range(k)], targets)
                best = (score, way) if best is None or score < best[0] else best
        assert O.divided(costs, targets) == best[1]
    costs = [7.0, 5, 4, 4, 3, 3, 3, 2, 2, 2, 1, 1, 1]
    sums = [sum(c for c, d in zip(costs, O.divided(costs, [12.0, 13, 13]), strict=True) if d == k) for k in range(3)]
    assert sums == [12, 13, 13]


def test_caps():
    assert O.capped([5, 9, 9, 1], 10) == [5, 1, 3, 1] and O.capped([5, 9], 1) == [1, 1] and O.capped([2, 3], 9) == [2, 3] and O.capped([1, 1, 4], 3) == [1, 1, 1]


def test_readings_agree_on_a_text(spark):
    rows = [("scan", ["Widget large 12 8.19", "a line of its own", "Total 20.00"]), ("text", ["Widget large 12 8.19", "Total 20.00"]), ("photo", ["Wldget large l2 8.19", "T0tal 20.00"])]
    lines = spark.createDataFrame([(1, v, n, t) for v, ts in rows for n, t in enumerate(ts)], "doc_id long, variant string, line_no int, text string")
    trust = {"scan": 3, "text": 2, "photo": 1}
    assert {(r.cluster, r.variant, r.line_no) for r in O.lines_aligned(lines, trust).collect()} == {(0, "scan", 0), (0, "text", 0), (0, "photo", 0), (1, "scan", 2), (1, "text", 1), (1, "photo", 1)}
    r = O.consensus(lines, trust).first()
    assert r.text == "Widget large 12 8.19\nTotal 20.00" and r.confidence == 0.0
    one = lines.filter("variant = 'text'")
    assert O.consensus(one, trust).first().text == "Widget large 12 8.19\nTotal 20.00" and O.consensus(one, trust).first().confidence == 1.0


def test_lines_are_compared_as_without_bounds():
    """Clusters equal those of a plain search by the full ratio."""
    from difflib import SequenceMatcher

    def plainly(lines, trust, like=0.55):
        lead = max(lines, key=lambda v: trust[v])
        free = {v: dict(rows) for v, rows in lines.items() if v != lead}
        out = []
        for n, line in lines[lead]:
            cluster = [(lead, n, line)]
            for v, rows in free.items():
                ratios = {k: SequenceMatcher(None, line, t).ratio() for k, t in rows.items()}
                if ratios and (top := max(ratios.values())) >= like:
                    k = next(k for k, r in ratios.items() if r == top)
                    cluster.append((v, k, rows.pop(k)))
            out += [cluster] if len(cluster) > 1 else []
        return out

    rng = random.Random(5)
    for _ in range(60):
        base = ["".join(rng.choices("abcde ", k=rng.choice([3, 9, 30, 230]))).strip() or "a" for _ in range(6)]
        misread = lambda t: "".join(rng.choice("abcde") if rng.random() < 0.3 else c for c in t)
        lines = {v: [(n, " ".join(misread(t).split()) or "a") for n, t in enumerate(base) if rng.random() < 0.9] for v in ("x", "y", "z")}
        lines = {v: rows for v, rows in lines.items() if rows}
        assert O.clusters_of(lines, {"x": 3, "y": 2, "z": 1}) == plainly(lines, {"x": 3, "y": 2, "z": 1})


def test_a_permissive_reading_must_meet_the_subtotal(spark):
    from tradeloom.operators.parsing import anchored

    ddl = "invoice_id long, seq int, quantity decimal(18,4), unit_cost decimal(18,4), total_cost decimal(18,2), extra string"
    D = Decimal
    items = [(1, 1, D(1), D(5), D(5), "a"), (2, 1, D(1), D(5), D(5), "a"), (3, 1, D(1), D(5), D(5), "a"), (4, 1, D(1), None, None, "a"), (5, 1, D(2), D(5), D(10), "a")]
    again = [(i, s, D(4), D(5), D(20), "b") for i in (1, 2, 3, 5, 6) for s in (1, 2)] + [(4, 1, None, None, None, "b")]
    subtotals = spark.createDataFrame([(1, D("10.02")), (2, D("10.03")), (3, None), (4, D(7)), (5, D(10)), (6, D(10))], "invoice_id long, subtotal decimal(18,2)")
    got = anchored(spark.createDataFrame(items, ddl), spark.createDataFrame(again, ddl), subtotals)
    assert got.columns == [*"invoice_id seq quantity unit_cost total_cost extra reread".split()]
    found = {(r.invoice_id, r.seq): (r.reread, r.quantity, r.total_cost) for r in got.collect()}
    new = (True, D(1), D(5))
    old = (False, D(1), D(5))
    assert found == {(1, 1): new, (1, 2): new, (2, 1): old, (3, 1): old, (4, 1): (False, D(1), None), (5, 1): (False, D(2), D(10)), (6, 1): new, (6, 2): new}
    assert anchored(spark.createDataFrame([], ddl), spark.createDataFrame([], ddl), subtotals).count() == 0


def test_bounded_refuses(spark):
    from tradeloom.operators.common import bounded

    with pytest.raises(ValueError):
        bounded(spark.range(50), 20)
    assert bounded(spark.range(5), 20).count() == 5


def test_groups_guard_division(spark):
    items = spark.createDataFrame([(1, 1, "a", Decimal(0), Decimal(5), True), (1, 2, "b", Decimal(2), Decimal(5), False), (1, 3, None, Decimal(2), Decimal(5), True)], "invoice_id long, line int, tariff_code string, quantity decimal(18,4), total_cost decimal(18,2), billable boolean")
    got = {r.tariff_code: r for r in R.by_tariff(items).collect()}
    assert got["a"].average == 0 and got["b"].cost == 0 and got["b"].other_cost == 5 and got["UNKNOWN"].average == Decimal("2.5")
    assert {r.tariff_code for r in R.by_tariff(items, all_rows=False).collect()} == {"a", "UNKNOWN"}


def test_prorated_residual(spark):
    rows = spark.createDataFrame([(1, Decimal(1)), (1, Decimal(1)), (1, Decimal(1)), (2, Decimal(0)), (2, Decimal(0))], "g int, w decimal(18,2)")
    got = R.prorated(rows, "g", F.lit(10), "w", "share").collect()
    assert sorted((r.g, r.share, r.residual) for r in got) == [(1, Decimal("3.33"), Decimal("0.01"))] * 3 + [(2, Decimal("5.00"), Decimal("0.00"))] * 2


def test_zero_items(spark):
    items = spark.createDataFrame([(1, 0, 0, 1), (1, 5, 5, 0), (1, 5, 5, 1), (2, 0, 0, 0)], "invoice_id int, total_cost int, unit_cost int, quantity int")
    totals = spark.createDataFrame([(1, 9), (2, 0)], "invoice_id int, invoice_total int")
    assert sorted(r.invoice_id for r in Q.zero_items_dropped(items, totals).collect()) == [1, 2]


def test_islands(spark):
    pages = spark.createDataFrame([(1, n, i) for n, i in enumerate(["A", None, "A", "B", None, None, "A"])] + [(2, 0, None), (2, 1, "A")], "doc int, n int, ident string")
    got = O.islands(pages, "doc", "n", "ident").orderBy("doc", "n").collect()
    assert [r.island for r in got] == [0, 0, 0, 1, 1, 1, 2, 0, 0] and [r.ident for r in got][:2] == ["A", None]


def test_partition_is_best():
    rng = random.Random(1)
    for _ in range(20):
        costs = [rng.uniform(1, 50) for _ in range(rng.randint(2, 8))]
        targets = [0.3 * sum(costs), 0.7 * sum(costs)]
        score = lambda way: O.deviation([sum(c for c, w in zip(costs, way, strict=True) if w == d) for d in (0, 1)], targets)  # noqa: E731, B023
        assert score(O.divided(costs, targets)) == min(score(w) for w in product((0, 1), repeat=len(costs)) if 0 < sum(w) < len(w))
    assert len(set(O.divided([5.0] * 30, [50.0, 100.0]))) == 2


@pytest.mark.parametrize(("packages", "total", "expected"), [([1, 1, 1], 2, [1, 1, 1]), ([3, 1, 2], 10, [5, 1, 4]), ([1, 1], 5, [3, 2]), ([5, 3], 4, [1, 3]), ([2, 2], 4, [2, 2])])
def test_packages(packages, total, expected):
    assert O.redistributed(packages, total) == expected


def test_greedy_keeps_exact_matches():
    # the first item's price match may not take the row that the second names
    assert M.greedy([(1, 1, 55), (1, 2, 30), (2, 1, 120)], 100, 30) == {2: (1, 120), 1: (2, 30)}
    assert M.greedy([(1, 2, 50), (1, 1, 50), (2, 1, 20)], 100, 30) == {1: (1, 50)}


def test_history(spark):
    e = spark.createDataFrame([(1, 1, "a", 0.5), (1, 2, "a", 0.9), (1, 3, "b", 0.7), (1, 4, "a", 0.1), (2, 1, None, 0.2)], "k int, n int, code string, confidence double")
    got = sorted((r.k, r.since, r.code, r.confidence, r.superseded_by, r.is_active) for r in H.superseded(e, "k", "code", "n").collect())
    assert got == [(1, 1, "a", 0.9, 3, False), (1, 3, "b", 0.7, 4, False), (1, 4, "a", 0.1, None, True), (2, 1, None, 0.2, None, True)]
    assert [(r.old, r.new) for r in H.changes(e, "k", "code", "n").orderBy("n").collect()] == [("a", "b"), ("b", "a")]


def test_formats(spark):
    specs = spark.createDataFrame([("b", 1, ["x"], [], []), ("a", 1, ["x"], [], []), ("c", 2, ["x"], ["y", "z"], ["no"]), ("d", 9, [], [], [])], "name string, priority int, all_of array<string>, any_of array<string>, none_of array<string>")
    docs = spark.createDataFrame([(1, "X"), (2, "x z"), (3, "x z NO"), (4, None), (5, "")], "id int, text string")
    assert [r.format for r in D.format_detected(docs, specs).orderBy("id").collect()] == ["a", "c", "a", None, None]


def test_sections(spark):
    got = column(spark, ["a START b END c STOP", "START only", "none"], lambda c: D.section(c, "START", ["STOP", "END"]))
    assert got == [" b ", " only", ""]


def test_dimension_size_is_checked(spark):
    assert "broadcast" in dimension(spark.range(10))._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in dimension(spark.range(30), 20)._jdf.queryExecution().analyzed().toString().lower()


def test_fan_out_keeps_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, t string")
    got = fanned_out(rows, F.col("t"), lambda k: k.withColumn("n", F.length("key"))).orderBy("id").collect()
    assert [(r.id, r.n) for r in got] == [(1, 1), (2, 1), (3, None)]


def test_emails_match_the_latest(spark):
    e = spark.sql("select * from values (1, 7, timestamp_ntz'2024-01-20', 'inv'), (2, 7, timestamp_ntz'2024-01-07', 'bl'), (3, 7, timestamp_ntz'2024-01-10', 'bl'), (4, 7, timestamp_ntz'2024-01-05', 'bl'), (5, 8, timestamp_ntz'2024-01-19', 'bl') t(message_id, client_id, received_at, kind)")
    assert [tuple(r) for r in M.emails_linked(e, "inv", "bl").collect()] == [(1, 3)]


def test_whole_tables_are_aligned_repaired_and_expanded(spark, tmp_path):
    import importlib

    order, lookups, scalars = (importlib.import_module(f"tradeloom.plans.{m}") for m in ("order", "lookups", "scalars"))
    d = str(tmp_path)
    turns = [(1, 1, "user", "word " * 60 + ". short line"), (1, 2, "user", "x" * 300)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    assert sorted(r["count"] for r in order.aligned(spark, d).groupBy("doc_id").count().collect()) == [3, 5]  # difflib finds long texts of few characters unlike
    spark.createDataFrame([(k, 100.0) for k in range(1, 9)], "o_orderkey long, o_totalprice double").write.parquet(f"{d}/orders.parquet")
    assert sum(r.n for r in lookups.digits(spark, d).collect()) == 8
    spark.createDataFrame([(k, "n", 1) for k in range(1, 11)], "p_partkey long, p_name string, p_size int").write.parquet(f"{d}/part.parquet")
    members = {(r.p_partkey, r.member) for r in scalars.QUERIES["bundle_expand"](spark, d).collect()}
    assert members == {(k, f"BASE{k}*") for k in range(1, 10)} | {(10, f"MF0{10 % 7 + 1}-0{10 % 9 + 1}*")}

"""Rows that operators shuffle, which must grow no faster than their input, and the same results as by definition."""

from __future__ import annotations

from tradeloom.operators import common as C
from tradeloom.operators import lookup as L
from tradeloom.operators import matching as M
from tradeloom.operators import review as V


def shuffled(spark, df) -> tuple[list[tuple], int]:
    """The rows of ``df``, sorted, and how many rows were written to shuffles for them."""
    sc = spark.sparkContext
    jvm, store = sc._gateway.jvm, sc._jsc.sc().statusStore()

    def written() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    rows = sorted(map(tuple, df.collect()))
    return rows, written() - before


def test_shipments_by_common_references(spark):
    """A common reference doesn't make a row of each pair; pairs with several references in common count once."""
    ours = [(i, [f"I{i}", f"P{i % 3}", *(["Q"] if i % 2 else []), *([None] if i % 5 == 0 else [])]) for i in range(900)]
    theirs = [(i, i % 9 + 1, i % 70, [f"I{i + 1}", f"P{i % 4}", *(["Q"] if i % 3 else []), f"I{i}"]) for i in range(600)]
    inv = spark.createDataFrame(ours, "invoice_id long, refs array<string>")
    ship = spark.createDataFrame(theirs, "shipment_id long, packages long, weight long, invoice_refs array<string>")
    expected = []
    for i, refs in ours:
        hits = [(p, w) for _, p, w, named in theirs if (set(refs) - {None}) & set(named)]
        expected.append((i, sum(p for p, _ in hits) if hits else 1, sum(w for _, w in hits)))
    rows, n = shuffled(spark, M.shipments_matched(inv, ship))
    assert rows == expected
    assert n < 50_000  # there are over 200,000 pairs


def test_references_are_cut_to_lengths_that_occur(spark):
    """A whole isn't cut into all of its parts, only into those that can be found."""
    parts = [f"2026{i:06d}" for i in range(300)] + ["", None, "26000001", "7X"]
    wholes = [f"PO2026{i * 7 % 400:06d}X" for i in range(300)] + [None, "", "7", "2026000001"]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, n = shuffled(spark, C.named_in(spark.createDataFrame([(p,) for p in parts], "part string"), spark.createDataFrame([(w,) for w in wholes], "whole string"), "part", "whole"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert rows == sorted((p, w) for p in parts if p for w in wholes if w and p in w)
    assert n < 10_000  # there are 300 x 91 parts


def test_scores_shuffle_no_pairs(spark, monkeypatch):
    """Aliases meet items, not pairs of items and orders."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(M, "sku", lambda c: F.upper(c))
    items = spark.range(60).select(F.lit(1).alias("invoice_id"), F.col("id").cast("int").alias("seq"), F.concat(F.lit("S"), "id").alias("sku"), F.lit(None).cast("string").alias("legacy_sku"), F.lit("").alias("catalog"), *[F.lit(0).alias(c) for c in ("quantity", "unit_cost", "total_cost")])
    orders = spark.range(60).select(F.lit(1).alias("invoice_id"), F.col("id").cast("int").alias("po_seq"), F.concat(F.lit("T"), "id").alias("po_sku"), F.lit("").alias("po_short"), F.lit("").alias("po_description"), *[F.lit(0).alias(c) for c in ("po_quantity", "po_price", "po_total")])
    aliases = spark.createDataFrame([(f"s{i}", f"t{i + 1}", "none") for i in range(0, 60, 2)] + [("t3", "s3", None), ("s1", "", "t1")], "sku string, bm_code string, supplier_item string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, n = shuffled(spark, M.po_scores(items, orders, "invoice_id", aliases).filter("score > 0").select("seq", "po_seq", "score"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert rows == sorted([(i, i + 1, 90) for i in range(0, 59, 2)] + [(3, 3, 90), (1, 1, 90)])
    assert n < 1000  # there are 3,600 pairs


def test_bundles_meet_first_items_only(spark):
    """Many items of one SKU don't meet each bundle; beginnings of any length count."""
    items = [(f"Brand#{i % 9}-{i % 4}", i, f"c{i}") for i in range(2000)] + [(None, -1, "none"), ("X", 3000, "x")]
    bundles = [(b, [f"Brand#{b % 12}-{b % 4}", f"Brand#{b % 10}*", "X*"]) for b in range(300)] + [(900, ["Br*"]), (901, ["nothing", "nothing*"]), (902, ["B"])]
    begins = lambda m, sku: sku.startswith(m[:-1]) if m.endswith("*") else sku == m
    expected = []
    for b, members in bundles:
        found = next((c for m in members for sku, _, c in sorted((x for x in items if x[0]), key=lambda x: x[1]) if begins(m, sku)), None)
        expected += [(b, found)] if found else []
    rows, n = shuffled(spark, L.bundles_inherit(spark.createDataFrame(bundles, "bundle_id long, members array<string>"), spark.createDataFrame(items, "sku string, seq long, code string")))
    assert rows == sorted(expected)
    assert n < 10_000  # there are over 60,000 pairs


def test_rows_of_order_files_are_counted_first(spark):
    rows = [(f"f{i % 3}", f"PO/{i} (2026-{i % 4}/ A-{i % 5} /2026{i % 4})" if i % 3 else "PO", f"INV/{i % 6}" if i % 2 else None) for i in range(900)]
    inv = [(i % 60, f"2026-{i % 7}" if i % 2 else f"x inv_{i % 9} A5") for i in range(300)] + [(70, "A-1"), (70, "2026-1"), (71, None)]
    expected = []
    for s in {s for s, _ in inv}:
        mine = [r.lower() for t, r in inv if t == s and r]
        bare = {r.replace("-", "") for r in mine}
        hits: dict[str, int] = {}
        for file, text, number in rows:
            listed = {x.strip().lower().replace("-", "") for x in text.split("(")[1].rstrip(")").split("/")} if "(" in text else None
            cell = (number or "").lower().replace("/", "_")
            if listed & bare if listed else cell and any(cell in x for r in mine for x in (r, r.replace("-", ""))):
                hits[file] = hits.get(file, 0) + 1
        if hits:
            file = min(hits, key=lambda f: (-hits[f], f))
            expected.append((s, file, hits[file]))
    made = V.order_file(spark.createDataFrame(rows, "file string, order_ref string, number string"), spark.createDataFrame(inv, "shipment_id long, ref string"))
    found, n = shuffled(spark, made.select("shipment_id", "file", "hits"))
    assert found == sorted(expected)
    assert n < 5_000  # there are over 10,000 pairs of a row and a shipment


def test_recap_meets_first_invoices_only(spark):
    refs, invoices = [f"INV-2024-{i:06d}-A" for i in range(0, 900, 2)], [f"INV-2024-{i:06d}{'-B' if i % 3 else ''}" for i in range(0, 900, 3)] + [f"INV-2024-{i:06d}-B" for i in range(1, 600, 7)] + ["X"]
    best = {}
    for r in refs:
        found = [(n, i) for n, cut in enumerate((15, 14, 13), 1) for i in invoices if len(i) >= cut and i[:cut] == r[:cut]]
        best[r] = min(found)[::-1] if found else (None, None)
    taken = {i for i, _ in best.values()}
    expected = [(r, *best[r]) for r in refs] + [(None, i, None) for i in set(invoices) - taken]
    rows = L.recap_matched(spark.createDataFrame([(r,) for r in refs], "ref string"), spark.createDataFrame([(i,) for i in invoices], "invoice_ref string"))
    joined = rows._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count("min(invoice_ref") >= 3  # before, each met all invoices of its beginning
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(expected, key=str)


def test_suppliers_of_like_names(spark):
    """Names that have their grams in common meet by whole parts."""
    suppliers = [(i, f"Supplier#{i:09d}", f"S{i}") for i in range(400)] + [(900, "Acme", None), (901, "", "E"), (902, None, None)]
    names = [f"Supplier#{i:09d} Ltd" for i in range(400)] + ["s7", "supplier#000000009", "the acme co", "cm", "Supplier", "nobody", "", None]
    expected = []
    for name in names:
        n = name.strip().lower() if name is not None else None
        tiers = [[i for i, _, c in suppliers if c and n == c.lower()], [i for i, s, _ in suppliers if s is not None and n == s.lower()], [i for i, s, _ in suppliers if n and s and (s.lower() in n or n in s.lower())]]
        found = next(((min(t), k) for k, t in enumerate(tiers, 1) if t), None) if n is not None else None
        expected += [(name, *found)] if found else []
    made = L.supplier_found(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(suppliers, "supplier_id long, name string, code string"))
    assert "__gram" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, made.select("name", "supplier_id", "tier").collect())) == sorted(expected)


def test_pairs_of_an_invoice_are_made_where_it_is(spark, sf):
    """Lines meet their part and are dealt by invoice, no more; the assignment is that of the scores of all pairs."""
    from itertools import groupby

    from tradeloom.plans import registry

    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    pairs = sorted(map(tuple, registry.queries()["po_score"](spark, sf).filter("score >= 30").collect()))
    expected = [(k, i, row, score) for k, own in groupby(pairs, lambda r: r[0]) for i, (row, score) in M.greedy([r[1:] for r in own], 100, 30).items()]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, n = shuffled(spark, registry.queries()["po_greedy_assign"](spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert rows == sorted(expected) and len(rows) > 100
    assert n < 3 * lines

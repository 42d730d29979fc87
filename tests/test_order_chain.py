"""Order matching as a whole, against the definitions invoice by invoice."""

from __future__ import annotations

import re

from tradeloom.operators import matching as M
from tradeloom.plans import order


def bare(ref):
    return re.sub("-[A-Z]$", "", ref).replace("-", "")


def norm(code):
    return re.sub(r"[^A-Z0-9]", "", (code or "").upper())


def by_force(invoices, items, orders, aliases, normal):
    pairs = {(normal[a], normal[b]) for a, b in aliases} | {(normal[b], normal[a]) for a, b in aliases}
    grams = {}
    for o in orders:
        for r in o.refs:
            grams.setdefault(bare(r), []).append(o)
    out = []
    for inv in invoices:
        ours = inv.ref.replace("-", "")
        named = {o.po_row: o for r, rows in grams.items() if r and (r in ours or ours in r) for o in rows}
        candidates = [named[k] for k in sorted(named)]
        mine = sorted((i for i in items.get(inv.invoice_id, [])), key=lambda i: i.seq)
        if not mine:
            for n, o in enumerate(candidates, 1):
                if len(o.refs) == 1 or inv.ref == re.sub("-[A-Z]$", "", o.refs[0]):
                    out.append((inv.invoice_id, n, o.po_item_ref, o.po_description, o.po_number, o.po_sku, o.po_description, float(o.po_quantity), float(o.po_price), float(o.po_total), o.uom, 0))
            continue

        def score(i, o):
            a, b, short = normal[i.sku], normal[o.po_sku], normal[o.po_short]
            partial = lambda x, y: min(len(x), len(y)) >= 3 and (x in y or y in x)
            s = 0
            if a and b:
                s += 100 if a == b else 50 if partial(a, b) else 90 if (a, b) in pairs else 0
            c = i.catalog or ""
            s += 80 if len(c) >= 3 and (c in o.po_sku or c in o.po_description) else 0
            s += 60 if short and a and (short == a or partial(short, a)) else 0
            q, p = float(i.quantity), float(o.po_quantity)
            s += 20 if q and q == p else 10 if q and p and abs(q - p) <= 1 else 0
            u, v = i.unit_cost, o.po_price
            s += 30 if u and v and abs(u - v) < 0.02 else 15 if u and v and abs(u - v) < 0.5 else 0
            return s + (25 if i.total_cost and o.po_total and abs(i.total_cost - o.po_total) < 0.02 else 0)

        points = {(x, y): score(i, o) for x, i in enumerate(mine) for y, o in enumerate(candidates)}
        found, used = {}, set()
        for enough in (100, 30):
            for x in range(len(mine)):
                free = [y for y in range(len(candidates)) if y not in used]
                if x in found or not free:
                    continue
                y = max(free, key=lambda y: (points[x, y], -y))
                if points[x, y] >= enough:
                    found[x] = y
                    used.add(y)
        for x, i in enumerate(mine):
            o = candidates[found[x]] if x in found else None
            out.append((
                i.invoice_id, i.seq, o.po_item_ref if o else "", o.po_description if o else "", o.po_number if o else "", i.sku or f"ITEM-{i.seq:03d}", i.description or (o.po_description if o else ""), float(i.quantity),
                float(i.unit_cost or (o.po_price if o else 0)), float(i.total_cost or (o.po_total if o else 0)), o.uom if o else "Unit", points[x, found[x]] if o else 0,
            ))
    return sorted(out)


def test_all_orders(spark, sf):
    from pyspark.sql import functions as F

    from tradeloom.functions.codes import sku

    inv, items, orders, aliases = order._chain(spark, sf)
    codes = items.select(F.col("sku").alias("c")).union(orders.select("po_sku")).union(orders.select("po_short")).union(aliases.select("sku")).union(aliases.select("bm_code")).distinct()
    normal = {r.c: r.n for r in codes.select("c", sku(F.col("c")).alias("n")).collect()}
    by_invoice = {}
    for i in items.collect():
        by_invoice.setdefault(i.invoice_id, []).append(i)
    expected = by_force(inv.collect(), by_invoice, orders.collect(), [(r.sku, r.bm_code) for r in aliases.collect()], normal)
    got = sorted(map(tuple, order.po_match(spark, sf).collect()))
    assert got == expected
    assert {r[-1] for r in got} >= {0} and len({r[-1] for r in got}) > 5 and any(r[0] % 9 == 0 for r in got)


def test_nothing_to_match(spark, sf):
    inv, items, orders, aliases = order._chain(spark, sf)
    unmatched = M.orders_matched(inv, items, orders.limit(0), aliases)
    assert unmatched.count() == items.count() and unmatched.filter("match_score > 0 OR po_number <> ''").count() == 0
    assert M.orders_matched(inv.limit(0), items.limit(0), orders, aliases).count() == 0


def test_references_of_other_lengths(spark):
    """References within others, empty ones, rows that name an invoice by several, and invoices without items."""
    from decimal import Decimal
    from types import SimpleNamespace as Row

    refs = ["2026-001", "2026-0012", "-", "X", "26001", "2026001Z", "9"]
    inv = [Row(invoice_id=n, ref=r) for n, r in enumerate(refs)]
    named = [["2026-001-B"], ["2026001", "PO2026-0012Y"], ["X", "9-A"], ["", "-"], ["XX9"], ["20260-01", "2026001Z"], ["9", "X"], ["nothing"], [], ["2026"]]
    price = lambda n: Decimal(n % 5 + 1).quantize(Decimal("0.0001"))
    orders = [Row(po_row=100 - n, po_number=f"PO{n}", refs=r, po_item_ref=f"R{n}", po_sku=f"S-{n % 4}00", po_short=f"P{n}", po_description=f"part {n}", po_quantity=price(n), po_price=price(n + 1), po_total=price(n), uom="EA") for n, r in enumerate(named)]
    items = {i: [Row(invoice_id=i, seq=n, sku="" if n == 3 else f"S{(n + i) % 5}00", legacy_sku=None, catalog=None, description=None, quantity=price(n + i), unit_cost=price(n), total_cost=price(n + 1)) for n in range(1, 5)] for i in (0, 1, 3)}
    aliases = [("s300", "s-100")]
    normal = {c: (c or "").upper().replace("-", "") for c in [r.sku for own in items.values() for r in own] + [o.po_sku for o in orders] + [o.po_short for o in orders] + ["s300", "s-100"]}
    expected = by_force([i for i in inv if i.ref != "-"], items, orders, aliases, normal)  # an empty reference names nothing
    frame = lambda rows, ddl: spark.createDataFrame([tuple(vars(r)[c.split()[0]] for c in ddl.replace("(18,4)", "").split(", ")) for r in rows], ddl)
    money = "decimal(18,4)"
    got = M.orders_matched(
        frame(inv, "invoice_id long, ref string"), frame([r for own in items.values() for r in own], f"invoice_id long, seq int, sku string, legacy_sku string, catalog string, description string, quantity {money}, unit_cost {money}, total_cost {money}"),
        frame(orders, f"po_row long, po_number string, refs array<string>, po_item_ref string, po_sku string, po_short string, po_description string, po_quantity {money}, po_price {money}, po_total {money}, uom string"),
        spark.createDataFrame([(a, b, None) for a, b in aliases], "sku string, bm_code string, supplier_item string"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert {r[0] for r in expected} >= {0, 1, 3, 6} and sum(r[-1] > 0 for r in expected) > 4


def test_orders_meet_invoices_once(spark, sf):
    """Order rows are dealt by reference and by invoice, lines by part and by invoice: a few rows a line, not one for each step."""
    from tests.test_growth import shuffled

    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    class Whole:
        def collect(self):
            return order.po_match(spark, sf).collect()

    try:
        rows, n = shuffled(spark, Whole())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(rows) > lines * 0.9
    assert n < 9 * lines

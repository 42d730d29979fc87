"""Matching of items with purchase orders, of invoices with shipments, of officers' codes, and of e-mails."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions.codes import sku
from tradeloom.operators.common import bounded, named_in, streamed, winners
from tradeloom.sources.shared import kept


@dataclass(frozen=True)
class Scores:
    """Points of a pair, and the least for each pass (fixed values)."""

    exact_sku: int = 100
    partial_sku: int = 50
    alias_sku: int = 90
    catalog: int = 80
    short_code: int = 60
    quantity: int = 20
    close_quantity: int = 10
    price: int = 30
    close_price: int = 15
    total: int = 25
    least: int = 30


def _close(a: Column, b: Column, within: float) -> Column:
    return (a != 0) & (b != 0) & (F.abs(a - b) < within)


def _partial(a: Column, b: Column) -> Column:
    return (F.least(F.length(a), F.length(b)) >= 3) & (F.contains(a, b) | F.contains(b, a))


def _bare(ref: Column) -> Column:
    return F.replace(ref, F.lit("-"), F.lit(""))


def _unversioned(ref: Column) -> Column:
    return F.regexp_replace(ref, "-[A-Z]$", "")


def po_candidates(invoices: DataFrame, orders: DataFrame) -> DataFrame:
    """invoice_id and order_id of orders that name the invoice: one of their references (``refs``) and the invoice's (``ref``), without hyphens,
    are equal or contain one another. A last hyphen and capital letter of an order's reference don't count; empty references name nothing."""
    ours = invoices.select("invoice_id", _bare(F.col("ref")).alias("__ours")).filter("__ours <> ''")
    theirs = orders.select("order_id", F.explode("refs").alias("__ref")).select("order_id", _bare(_unversioned(F.col("__ref"))).alias("__theirs")).filter("__theirs <> ''").distinct()
    # distinct references meet, so that a common one isn't joined once for each of its rows
    a, b = ours.select("__ours").distinct(), theirs.select("__theirs").distinct()
    met = named_in(a, b, "__ours", "__theirs").select("__ours", "__theirs").union(named_in(b, a, "__theirs", "__ours").select("__ours", "__theirs")).distinct()
    return ours.join(met, "__ours").join(theirs, "__theirs").select("invoice_id", "order_id").distinct()


def unlike_references(ours: DataFrame, theirs: DataFrame) -> DataFrame | None:
    """__ours and __theirs: texts of the two (of these columns) that differ, and of which one contains the other; None if by their lengths no text can.

    Only texts that are short enough for one of the other side, or long enough, are made distinct and meet.
    """
    a, b = ({n for (n,) in rows.select(F.length(c)).distinct().collect()} for rows, c in ((ours, "__ours"), (theirs, "__theirs")))
    found = []
    for parts, part, short, wholes, whole, long in ((ours, "__ours", a, theirs, "__theirs", b), (theirs, "__theirs", b, ours, "__ours", a)):
        if short and long and min(short) < max(long):
            left, right = kept(parts.filter(F.length(part) < max(long)).select(part).distinct(), "parts"), kept(wholes.filter(F.length(whole) > min(short)).select(whole).distinct(), "wholes")
            found.append(named_in(left, right, part, whole).filter("__ours <> __theirs").select("__ours", "__theirs"))
    return found[0].union(found[1]) if len(found) > 1 else found[0] if found else None


def alias_pairs(aliases: DataFrame) -> DataFrame:
    """__a and __b: normalised SKUs that name one product by ``aliases`` (sku, bm_code, supplier_item), read both ways: the key with either code."""
    known = aliases.select(sku(F.col("sku")).alias("__a"), F.explode(F.array("bm_code", "supplier_item")).alias("code")).filter("code IS NOT NULL").select("__a", sku(F.col("code")).alias("__b"))
    return known.union(known.select("__b", "__a")).filter("__a <> '' AND __b <> ''").distinct()


def with_named(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """``rows`` (sku) with ``named``: the normalised SKUs that are aliases of theirs."""
    known = alias_pairs(aliases).groupBy("__a").agg(F.collect_list("__b").alias("named"))
    return rows.withColumn("__a", sku(F.col("sku"))).join(known, "__a", "left").drop("__a")


def _own() -> dict[str, Column]:
    return {"__a": sku(F.col("sku")), "__legacy": sku(F.col("legacy_sku"))}


def _theirs(po_sku: Column, po_short: Column) -> dict[str, Column]:
    return {"__b": sku(po_sku), "__short": sku(po_short)}


def po_scores(items: DataFrame, orders: DataFrame, on: str, aliases: DataFrame, s: Scores = Scores()) -> DataFrame:
    """Pairs of ``items`` and ``orders`` with one value of ``on``, with ``score``. SKUs count once, by the best way; catalogue, short code,
    quantity, price and total add to it. Items get the codes that are aliases of theirs before they meet orders, so no pair is shuffled.

    Columns: sku, legacy_sku, catalog, quantity, unit_cost, total_cost of the item; po_sku, po_short, po_description, po_quantity,
    po_price, po_total of the order. aliases: see ``alias_pairs``. SKUs are normalised before the join, once a row.
    """
    left = with_named(items, aliases).withColumns(_own())
    return _scored(left.join(orders.withColumns(_theirs(F.col("po_sku"), F.col("po_short"))), on), s)


def po_scores_within(items: DataFrame, on: str, order: Column, s: Scores = Scores()) -> DataFrame:
    """The same where each row of ``items`` (with ``named``) is an order row of its ``on``, too: ``order``, a struct of the order's columns. Rows are dealt by
    ``on`` once, and their pairs follow one another in one task."""
    theirs = order
    for name, value in _theirs(order["po_sku"], order["po_short"]).items():
        theirs = theirs.withField(name, value)
    met = items.withColumns(_own() | {"__orders": F.collect_list(theirs).over(Window.partitionBy(on))})
    return _scored(met.withColumn("__order", F.explode("__orders")).drop("__orders").select("*", "__order.*").drop("__order"), s)


def _scored(pairs: DataFrame, s: Scores) -> DataFrame:
    return pairs.withColumn("score", _score(F.col, F.col, s)).drop("__a", "__b", "__short", "__legacy", "named")


def _score(item: Callable[[str], Column], order: Callable[[str], Column], s: Scores) -> Column:
    """Points of a pair by the columns of its item and its order."""
    a, b, short, legacy = item("__a"), order("__b"), order("__short"), item("__legacy")
    both = (a != "") & (b != "")
    by_sku = F.when(both & (a == b), s.exact_sku).when(both & _partial(a, b), s.partial_sku).when(both & F.array_contains(item("named"), b), s.alias_sku)
    by_legacy = F.when((legacy != "") & ((legacy == b) | (legacy == short)), s.exact_sku)
    catalog = F.coalesce(item("catalog"), F.lit(""))
    listed = (F.length(catalog) >= 3) & (F.contains(order("po_sku"), catalog) | F.contains(order("po_description"), catalog))
    by_short = (short != "") & (a != "") & ((short == a) | _partial(short, a))
    q, p = item("quantity"), order("po_quantity")
    cost, price = item("unit_cost"), order("po_price")
    points = [
        F.coalesce(by_sku, by_legacy),
        F.when(listed, s.catalog),
        F.when(by_short, s.short_code),
        F.when((q != 0) & (p != 0), F.when(q == p, s.quantity).when(F.abs(q - p) <= 1, s.close_quantity)),
        F.when(_close(cost, price, 0.02), s.price).when(_close(cost, price, 0.50), s.close_price),
        F.when(_close(item("total_cost"), order("po_total"), 0.02), s.total),
    ]
    return sum((F.coalesce(x, F.lit(0)) for x in points), F.lit(0))


def greedy(pairs: list[tuple[int, int, int]], first: int, least: int) -> dict[int, tuple[int, int]]:
    """item -> (order row, score) from (item, order row, score): items in order take their best free row, those of at least
    ``first`` points before all others; ties go to the earlier row."""
    by_item: dict[int, list[tuple[int, int]]] = {}
    for item, row, score in pairs:
        by_item.setdefault(item, []).append((-score, row))
    found: dict[int, tuple[int, int]] = {}
    used: set[int] = set()
    for enough in (first, least):
        for item in sorted(by_item):
            if item in found:
                continue
            best = min((p for p in by_item[item] if p[1] not in used), default=None)
            if best and -best[0] >= enough:
                found[item] = (best[1], -best[0])
                used.add(best[1])
    return found


def po_assigned(scored: DataFrame, s: Scores = Scores(), grouped: bool = False) -> DataFrame:
    """invoice_id, seq, po_seq and score: one order row for an item, one item for an order row, within an invoice.

    Only pairs worth taking are grouped; one invoice, which one document bounds, is one group. ``grouped``: see ``streamed``.
    """

    def assign(rows: list[tuple]) -> list[tuple]:
        return [(rows[0][0], i, row, score) for i, (row, score) in greedy([r[1:] for r in rows], s.exact_sku, s.least).items()]

    worth = scored.filter(F.col("score") >= s.least)
    return streamed(worth, "invoice_id", ["invoice_id", "seq", "po_seq", "score"], ["seq", "po_seq"], assign, "invoice_id long, seq int, po_seq int, score int", grouped)


#: Of an order row, what the matched item takes from it, and what scores need besides.
TAKEN = ("po_item_ref", "po_description", "po_number", "po_sku", "po_quantity", "po_price", "po_total", "uom")
SCORED = ("po_short", "__b", "__short")


def _assigner(s: Scores) -> Callable[..., Column]:
    """For the items, rows (by their places) and scores of an invoice's pairs, and its number of items: the row and score of each item, null without one."""

    @F.arrow_udf("array<struct<row: int, score: int>>")
    def assigned(item: pa.Array, row: pa.Array, score: pa.Array, items: pa.Array) -> pa.Array:
        ends, rows, scores, at = [0], [], [], 0
        each = list(zip(*(c.flatten().to_pylist() for c in (item, row, score)), strict=True))
        for n, many in zip(item.value_lengths().fill_null(0).to_pylist(), items.to_pylist(), strict=True):
            found = greedy(each[at : at + n], s.exact_sku, s.least)
            own = [found.get(i, (None, None)) for i in range(many)]
            rows += [r for r, _ in own]
            scores += [p for _, p in own]
            ends.append(len(rows))
            at += n
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rows, pa.int32()), pa.array(scores, pa.int32())], ["row", "score"]))

    return assigned


def _within_invoice(rows: DataFrame, order: list[str], columns: list[str], name: str) -> DataFrame:
    """invoice_id and its rows as an array, in order. By a window, as that needs no more than the sort by which invoices are joined, too."""
    own = Window.partitionBy("invoice_id").orderBy(*order)
    every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = rows.select("invoice_id", F.row_number().over(own).alias("__n"), F.collect_list(F.struct(*columns)).over(every).alias(name))
    return listed.filter("__n = 1").drop("__n")


def orders_matched(invoices: DataFrame, items: DataFrame, orders: DataFrame, aliases: DataFrame, s: Scores = Scores(), fields: dict[str, Column] | None = None) -> DataFrame:
    """Every item of every invoice with the order row that it is matched with: candidates by reference (as in ``po_candidates``), scores, one to one assignment.

    ``invoices``: invoice_id, ref; ``items``: invoice_id, seq, sku, legacy_sku, catalog, description, quantity, unit_cost, total_cost; ``orders``: po_row (in
    order), po_number, refs, po_item_ref, po_sku, po_short, po_description, po_quantity, po_price, po_total, uom. What an item lacks comes from its
    order row; an item without a match has empty order fields and a score of 0. An invoice without items has the order rows that name it alone, or
    first. ``items`` may have ``named`` (see ``with_named``), then ``aliases`` isn't read. ``fields``: those columns of ``orders`` that are made of its others;
    they are made when rows are where their invoice is, and so aren't shuffled.

    Orders are kept as a table, as they are read several times. Their rows are dealt by reference and by invoice, once each, and items by invoice; all else
    is done within an invoice's row, which one document bounds.
    """
    fields, seq = fields or {}, items.schema["seq"].dataType
    orders = kept(orders, "orders")
    given = [c for c in orders.columns if c != "refs"]
    single, clean = F.size("refs") == 1, _unversioned(F.col("__ref"))
    each = orders.select("*", F.posexplode("refs").alias("__at", "__ref")).select(*given, single.alias("__single"), F.when(~single & (F.col("__at") == 0), clean).alias("__first"), _bare(clean).alias("__theirs")).filter("__theirs <> ''")
    ours = invoices.select("invoice_id", "ref", _bare(F.col("ref")).alias("__ours")).filter("__ours <> ''")
    named = ours.withColumnRenamed("__ours", "__theirs")
    if (unlike := unlike_references(ours, each)) is not None:
        named = named.unionByName(ours.join(unlike, "__ours").drop("__ours"))
    # a row comes once for each of its references that name the invoice; the one by which it names it alone or first is before the others
    later = ~(F.col("__single") | F.coalesce(F.col("ref") == F.col("__first"), F.lit(False)))
    met = each.join(named, "__theirs").select("invoice_id", *given, later.alias("__later")).repartition("invoice_id")
    made = met.withColumns(fields).withColumns(_theirs(F.col("po_sku"), F.col("po_short")))
    rows = _within_invoice(made, ["po_row", "__later"], ["po_row", "__later", *TAKEN, *SCORED], "__all")
    once = F.filter("__all", lambda r, n: (n == 0) | (r["po_row"] != F.get("__all", n - 1)["po_row"]))
    own = (items if "named" in items.columns else with_named(items, aliases)).withColumns(_own())
    listed = _within_invoice(own, ["seq"], [c for c in own.columns if c != "invoice_id"], "__items")
    both = listed.join(rows.select("invoice_id", once.alias("__rows")), "invoice_id", "full_outer")
    pair = lambda i, x: F.transform("__rows", lambda r, y: F.struct(x.alias("item"), y.alias("row"), _score(i.getField, r.getField, s).alias("score")))
    pairs = F.flatten(F.transform("__items", lambda i, x: F.filter(pair(i, x), lambda p: p["score"] >= s.least)))
    found = both.withColumn("__pairs", pairs).withColumn("__found", _assigner(s)(*[F.col(f"__pairs.{c}") for c in ("item", "row", "score")], F.greatest(F.size("__items"), F.lit(0))))
    out = F.transform(F.arrays_zip("__items", "__found"), lambda m: F.struct(m["__items"]["seq"].alias("seq"), m["__items"].alias("i"), F.get("__rows", m["__found"]["row"]).alias("o"), m["__found"]["score"].alias("score")))
    none = F.lit(None).cast(both.schema["__items"].dataType.elementType)
    alone = F.filter(F.transform("__rows", lambda r, y: F.struct((y + 1).cast(seq).alias("seq"), none.alias("i"), r.alias("o"), F.lit(None).cast("int").alias("score"))), lambda p: ~p["o"]["__later"])
    each = found.select("invoice_id", F.explode(F.when(F.col("__items").isNull(), alone).otherwise(out)).alias("m")).select("invoice_id", "m.*")
    i, o, number = F.col("i"), F.col("o"), lambda c: F.nullif(F.col("i")[c], F.lit(0).cast(items.schema[c].dataType))
    text, whole = lambda c: F.nullif(i[c], F.lit("")), lambda a, b: F.when(i.isNull(), a).otherwise(b)
    return each.select(
        "invoice_id", "seq", *[whole(o[c], F.coalesce(o[c], F.lit(""))).alias(c) for c in ("po_item_ref", "po_description", "po_number")],
        whole(o["po_sku"], F.coalesce(text("sku"), F.concat(F.lit("ITEM-"), F.lpad(F.col("seq").cast("string"), 3, "0")))).alias("supplier_item"),
        whole(o["po_description"], F.coalesce(text("description"), o["po_description"], F.lit(""))).alias("supplier_item_desc"),
        whole(o["po_quantity"].cast("double"), F.coalesce(i["quantity"], o["po_quantity"], F.lit(0)).cast("double")).alias("quantity"),
        whole(o["po_price"].cast("double"), F.coalesce(number("unit_cost"), o["po_price"], F.lit(0)).cast("double")).alias("unit_price"),
        whole(o["po_total"].cast("double"), F.coalesce(number("total_cost"), o["po_total"], F.lit(0)).cast("double")).alias("total_cost"),
        whole(o["uom"], F.coalesce(o["uom"], F.lit("Unit"))).alias("uom"), F.coalesce("score", F.lit(0)).alias("match_score"),
    )


#: A reference that more invoices and more shipments than this have is matched by sums, without a row a pair.
COMMON_REF = 16


def shipments_matched(invoices: DataFrame, shipments: DataFrame, refs: str = "refs", shipment_refs: str = "invoice_refs") -> DataFrame:
    """invoice_id, packages and weight of the shipments that name one of the invoice's references; 1 and 0 where none does. A shipment counts once for an invoice.

    Pairs of an invoice and a shipment are listed only for references that few rows of either side have, so they are at most ``COMMON_REF`` times the rows.
    For common references, rows are grouped by the set of those that they have, and sets meet instead of rows; a pair that has a rare reference in
    common, too, is taken out of the sums again.
    """
    ours = invoices.select("invoice_id", F.explode(F.array_distinct(refs)).alias("ref")).filter("ref IS NOT NULL").distinct()
    theirs = shipments.select("shipment_id", F.explode(F.array_distinct(shipment_refs)).alias("ref")).filter("ref IS NOT NULL").distinct()
    often = lambda rows: rows.groupBy("ref").agg(F.count("*").alias("n")).filter(F.col("n") > COMMON_REF).select("ref")
    common = often(ours).join(often(theirs), "ref").withColumn("__common", F.lit(True))
    sets = lambda rows, key: rows.join(common, "ref").groupBy(key).agg(F.array_sort(F.collect_list("ref")).alias("set"))
    held, named = sets(ours, "invoice_id"), sets(theirs, "shipment_id")
    amounts = shipments.select("shipment_id", "packages", "weight").dropDuplicates(["shipment_id"])
    # sets of references that meet, each pair once, with what the shipments of the one set have
    whole = named.join(amounts, "shipment_id").groupBy("set").agg(F.sum("packages").alias("packages"), F.sum("weight").alias("weight"))
    a = held.select("set").distinct().select("set", F.explode("set").alias("ref"))
    b = whole.select(F.col("set").alias("other"), F.explode("set").alias("ref"))
    met = a.join(b, "ref").select("set", "other").distinct().join(whole.withColumnRenamed("set", "other"), "other")
    by_set = held.join(met.groupBy("set").agg(F.sum("packages").alias("packages"), F.sum("weight").alias("weight")), "set").select("invoice_id", "packages", "weight")
    rare = ours.join(theirs.join(common, "ref", "left_anti"), "ref").select("invoice_id", "shipment_id").distinct()
    pairs = rare.join(held, "invoice_id", "left").join(named.withColumnRenamed("set", "other"), "shipment_id", "left")
    by_pair = pairs.filter(~F.coalesce(F.arrays_overlap("set", "other"), F.lit(False))).join(amounts, "shipment_id").select("invoice_id", "packages", "weight")
    sums = by_set.unionByName(by_pair).groupBy("invoice_id").agg(F.sum("packages").alias("packages"), F.sum("weight").alias("weight"))
    return invoices.select("invoice_id").join(sums, "invoice_id", "left").select("invoice_id", F.coalesce("packages", F.lit(1)).alias("packages"), F.coalesce("weight", F.lit(0)).alias("weight"))


def eliminated(invoices: DataFrame, shipments: DataFrame, matched: DataFrame, group: str) -> DataFrame:
    """group, invoice_id, packages: where one invoice of a group is unmatched, it takes all shipments nobody claimed."""
    left = invoices.join(matched.select("invoice_id").distinct(), "invoice_id", "left_anti")
    alone = left.groupBy(group).agg(F.count("*").alias("n"), F.min("invoice_id").alias("invoice_id")).filter("n = 1")
    free = shipments.join(matched.select("shipment_id").distinct(), "shipment_id", "left_anti").groupBy(group).agg(F.sum("packages").alias("packages"), F.count("*").alias("shipments"))
    return alone.join(free, group).select(group, "invoice_id", "packages", "shipments")


def exported_compared(generated: DataFrame, exported: DataFrame, key: str = "item_id") -> DataFrame:
    """``key`` and outcome of each generated row: accepted, modified, or rejected where it was not exported."""
    out = generated.select(key, F.col("code").alias("ours")).join(exported.select(key, F.col("code").alias("theirs")), key, "left")
    return out.select(key, "ours", "theirs", F.when(F.col("theirs").isNull(), "rejected").when(F.col("ours") == F.col("theirs"), "accepted").otherwise("modified").alias("outcome"))


def lists_compared(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and finding where two lists, aligned by ordinal, differ: a row that one lacks, or the columns that differ."""
    left, right = a.select(*keys, F.struct(*columns).alias("__a")), b.select(*keys, F.struct(*columns).alias("__b"))
    joined = left.join(right, keys, "full_outer")
    differs = F.concat_ws(",", *[F.when(~F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")), F.lit(c)) for c in columns])
    finding = F.when(F.col("__a").isNull(), "missing_in_a").when(F.col("__b").isNull(), "missing_in_b").otherwise(differs)
    return joined.select(*keys, finding.alias("finding")).filter("finding <> ''")


def fixed(items: DataFrame, fixes: DataFrame) -> DataFrame:
    """``items`` after fixes (invoice_id, line, action, quantity, unit_cost, version): the last version of a fix counts; ``delete`` drops a
    row, ``override`` replaces what it gives and recomputes the total."""
    last = winners(fixes, ["invoice_id", "line"], F.col("version").desc()).select(
        "invoice_id", "line", "action", F.col("quantity").alias("__q"), F.col("unit_cost").alias("__u")
    )
    out = items.join(last, ["invoice_id", "line"], "left").filter(F.coalesce("action", F.lit("")) != "delete")
    kinds = dict(items.dtypes)
    q = F.coalesce("__q", "quantity").cast(kinds["quantity"])
    u = F.coalesce("__u", "unit_cost").cast(kinds["unit_cost"])
    changed = F.col("__q").isNotNull() | F.col("__u").isNotNull()
    total = F.when(changed, F.round((q * u).cast("decimal(28,8)"), 2)).otherwise(F.col("total_cost")).cast(kinds["total_cost"])
    given = {"quantity": q, "unit_cost": u, "total_cost": total}
    return out.select(*[given.get(c, F.col(c)).alias(c) for c in items.columns])


def officer_pairs(ours: list[tuple], theirs: list[tuple], least: float) -> list[tuple]:
    """(seq, official_seq, how) of rows (seq, sku, description). An official row, in turn, takes ours of its SKU, else of its description, else the
    first whose words are alike by ``least`` of the larger set. Of ours with one SKU or description the last counts; each is taken once by
    SKU and once by description."""
    by_sku = {k.lower(): n for n, k, _ in ours if k}
    by_text = {d: n for n, _, d in ours if d}
    out = []
    for n, code, text in theirs:
        code, mine = (code or "").lower(), set((text or "").split())
        if code in by_sku:
            out.append((by_sku.pop(code), n, "sku"))
        elif text in by_text:
            out.append((by_text.pop(text), n, "description"))
        else:
            alike = (d for d in by_text if mine and len(mine & (w := set(d.split()))) >= least * max(len(mine), len(w)))
            if (found := next(alike, None)) is not None:
                out.append((by_text.pop(found), n, "words"))
    return out


def officer_matched(items: DataFrame, official: DataFrame, least: float = 0.60) -> DataFrame:
    """shipment_id, seq, official_seq and how, as in ``officer_pairs``: both sides (shipment_id, seq, sku, description) in order of seq.

    One shipment is one group; both sides are bounded by its declaration.
    """

    def match(rows: list[tuple]) -> list[tuple]:
        ours, theirs = ([r[2:] for r in rows if r[1] == side] for side in (0, 1))
        return [(rows[0][0], *pair) for pair in officer_pairs(ours, theirs, least)]

    columns = ["shipment_id", "seq", "sku", "description"]
    both = items.select(*columns, F.lit(0).alias("side")).unionByName(official.select(*columns, F.lit(1).alias("side")))
    return streamed(both, "shipment_id", ["shipment_id", "side", "seq", "sku", "description"], ["side", "seq"], match, "shipment_id long, seq int, official_seq int, how string")


def emails_linked(emails: DataFrame, has: str, lacks: str, days: int = 14) -> DataFrame:
    """message_id and other_id: messages of one kind with the latest earlier message of the other kind, of the same client, within
    ``days``. A range join made an equi join on client and week of days, so no client is one task's window."""
    span = days * 86400
    when = F.unix_micros(F.col("received_at").cast("timestamp")) / 1_000_000
    marked = emails.withColumn("__at", when)
    a = marked.filter(F.col("kind") == has).withColumn("__slot", F.explode(F.array(F.floor(F.col("__at") / span), F.floor(F.col("__at") / span) - 1)))
    b = marked.filter(F.col("kind") == lacks).select("client_id", F.col("message_id").alias("other_id"), F.col("__at").alias("__then"), F.floor(F.col("__at") / span).alias("__slot"))
    near = a.join(b, ["client_id", "__slot"]).filter((F.col("__then") < F.col("__at")) & (F.col("__then") > F.col("__at") - span))
    return near.groupBy("message_id").agg(F.max_by("other_id", F.struct("__then", "other_id")).alias("other_id"))


def consignees(names: DataFrame, rules: DataFrame, name: str) -> DataFrame:
    """``names`` with the consignee of the first rule (seq, match, code) that the name contains; ``UNKNOWN`` if none."""
    found = names.select(name).distinct().crossJoin(bounded(rules)).filter(F.contains(F.lower(name), F.lower("match")))
    return names.join(winners(found, [name], F.col("seq")).select(name, F.col("code").alias("consignee")), name, "left").fillna("UNKNOWN", ["consignee"])

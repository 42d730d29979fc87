"""The items of an invoice divided among its declarations, by the first strategy that gives a reliable answer.

1. ``duty``: what each declaration's duty implies, by reverse calculation, is its target.
2. ``charges``: as many card charges as declarations, without tax, in the order that fits best, are the targets.
3. ``mixed``: unknown targets are filled in from the charges, in the order in which the known ones fit best.
4. ``quantity``: fewer items than declarations, but enough units: units are dealt in turn.
5. ``turn``: items are dealt in turn.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal
from itertools import chain, permutations
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions.money import DutyRates
from tradeloom.operators.common import streamed_together
from tradeloom.operators.ordering import _sums, deviation, divided_together, unreliable

FALLBACK_TAX = 0.07
#: A charge further from a declaration's items with tax than this is a mismatch.
MOST_OFF = 2.0


def duty_candidates(local: Column, foreign: Column, hand_local: Column, hand_foreign: Column, rates: DutyRates = DutyRates()) -> Column:
    """The positive duties that a declaration states, as text, in local currency, in order and without repeats."""

    def amount(c: Column, is_foreign: bool) -> Column:
        n = F.regexp_replace(c.cast("string"), r"[,$\s]", "").try_cast("double")
        return F.when(n > 0, F.round(n * rates.exchange, 2) if is_foreign else n)

    return F.array_distinct(F.array_compact(F.array(amount(local, False), amount(foreign, True), amount(hand_local, False), amount(hand_foreign, True))))


def targets_from_duties(declarations: DataFrame, items: DataFrame, rates: DutyRates = DutyRates()) -> DataFrame:
    """``declarations`` (invoice_id, declaration, duties, freight, insurance) with ``target``: the items' value that the first duty with a positive one
    implies, else the first duty in foreign currency; null without duties. The rate is the items' mean, weighted by cost (``items``: invoice_id,
    total_cost, rate)."""
    weight, cost = F.coalesce(F.col("rate").cast("decimal(10,6)"), F.lit(str(rates.common)).cast("decimal(10,6)")), F.col("total_cost").cast("decimal(18,2)")
    mean = items.groupBy("invoice_id").agg(F.sum(cost * weight).cast("double").alias("__w"), F.sum(cost).cast("double").alias("__c"))
    mean = mean.select("invoice_id", F.when(F.col("__c") > 0, F.col("__w") / F.col("__c")).otherwise(rates.common).alias("mean_rate"))
    composite = F.lit(1 + rates.vat) * F.coalesce("mean_rate", F.lit(rates.common)) + F.lit(rates.service * (1 + rates.vat) + rates.vat)
    positive = lambda c: F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    implied = F.filter(F.transform("duties", lambda d: d / composite / rates.exchange - positive("freight") - positive("insurance")), lambda x: x > 0)
    return declarations.join(mean, "invoice_id", "left").withColumn("target", F.coalesce(F.get(implied, F.lit(0)), F.get("duties", F.lit(0)) / rates.exchange))


#: Work that asks for divisions (costs, targets) one after another, so that those of many invoices can be answered together.
Asking = Generator[tuple[list[float], list[float]], list[int], Any]


def answered(asking: Sequence[Asking]) -> list[Any]:
    """What each of ``asking`` returns; what they ask for at one time is divided together."""
    out: list[Any] = [None] * len(asking)
    answers: list[tuple[int, list[int] | None]] = [(i, None) for i in range(len(asking))]
    while answers:
        waiting, wanted = [], []
        for i, way in answers:
            try:
                wanted.append(asking[i].send(way))
                waiting.append(i)
            except StopIteration as e:
                out[i] = e.value
        answers = list(zip(waiting, divided_together(wanted), strict=True))
    return out


def reliable(costs: list[float], targets: list[float]) -> Asking:
    """A division that leaves no declaration empty and can be trusted; None if there is none."""
    n = len(targets)
    if len(costs) < n:
        return None
    way = yield costs, targets
    if len(set(way)) < n or unreliable(deviation(_sums(costs, way, n), targets)[0], targets):
        return None
    return way


def _orders(charges: list[float]) -> list[tuple[float, ...]]:
    """All orders of the charges, those that are alike once."""
    return list(dict.fromkeys(permutations(charges)))


def strategy(costs: list[float], targets: list[float | None], charges: list[float], tax_share: float) -> tuple[str, list[int]] | None:
    """The first of the strategies by amounts that works, and each item's declaration."""
    return answered([_strategy(costs, targets, charges, tax_share)])[0]


def _strategy(costs: list[float], targets: list[float | None], charges: list[float], tax_share: float) -> Asking:
    n = len(targets)
    known = [i for i, t in enumerate(targets) if t is not None]
    if len(known) == n and (way := (yield from reliable(costs, targets))):
        return "duty", way
    untaxed = [c / (1 + tax_share) for c in charges]
    if len(charges) == n and len(costs) >= n:
        best, best_score = None, (math.inf, math.inf)
        for wanted in _orders(untaxed):
            way = yield costs, list(wanted)
            worst, gaps = deviation(_sums(costs, way, n), list(wanted))
            score = round(worst, 9), round(gaps, 6)  # orders that differ by the order of additions only are alike: the first counts
            if score < best_score:
                best, best_score, best_wanted = way, score, wanted
        if best is not None and len(set(best)) == n and not unreliable(best_score[0], list(best_wanted)):
            return "charges", best
    filled = list(targets)
    if len(known) < n and len(charges) == n:
        fits = min(_orders(untaxed), key=lambda order: sum(abs(order[i] - targets[i]) for i in known))
        filled = [fits[i] if t is None else t for i, t in enumerate(targets)]
    if all(t is not None for t in filled) and (known or charges) and (way := (yield from reliable(costs, filled))):
        return "mixed", way
    return None


def cents(x: float) -> float:
    """Two decimals, half up, of the number as it is written."""
    return float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP))


def split(rows: list[tuple], n: int) -> list[tuple]:
    """Rows (invoice_id, seq, description, tariff_code, quantity, unit_cost, total_cost, targets, charges, tax_share) of one invoice as rows
    (invoice_id, declaration, seq, quantity, unit_cost, total_cost, strategy)."""
    return answered([_split(rows, n)])[0]


def _split(rows: list[tuple], n: int) -> Asking:
    costs = [float(r[6] or 0) for r in rows]
    found = yield from _strategy(costs, list(rows[0][7]), [float(c) for c in rows[0][8] or []], rows[0][9])
    if found:
        return [(r[0], d, r[1], float(r[4] or 1), r[5], round(c, 2), found[0]) for r, c, d in zip(rows, costs, found[1], strict=True)]
    quantities = [int(r[4] or 1) or 1 for r in rows]
    if len(rows) < n <= sum(quantities):
        merged: dict[tuple, list] = {}
        turn = 0
        for r, c, q in zip(rows, costs, quantities, strict=True):
            unit = float(r[5] or 0) or c / q
            for _ in range(q):
                # units of one description and code are one line of their declaration; the first gives its price
                line = merged.setdefault((turn % n, r[2], r[3]), [r[0], turn % n, r[1], 0.0, unit, 0.0, "quantity"])
                line[3] += 1
                line[5] = round(line[5] + cents(unit), 2)
                turn += 1
        return [tuple(line) for line in merged.values()]
    return [(r[0], i % n, r[1], float(r[4] or 1), r[5], round(c, 2), "turn") for i, (r, c) in enumerate(zip(rows, costs, strict=True))]


def items_split(items: DataFrame, declarations: DataFrame, invoices: DataFrame) -> DataFrame:
    """invoice_id, declaration, seq, quantity, unit_cost, total_cost and strategy: every item (or its units) in one declaration.

    ``items``: invoice_id, seq, description, tariff_code, quantity, unit_cost, total_cost; ``declarations``: invoice_id, declaration (its place), target;
    ``invoices``: invoice_id, tax, invoice_total, charges (array). Invoices with one declaration or none are left out. One invoice is one group.
    """
    wanted = declarations.groupBy("invoice_id").agg(F.sort_array(F.collect_list(F.struct("declaration", "target"))).alias("t"))
    wanted = wanted.filter(F.size("t") > 1).select("invoice_id", F.transform("t", lambda x: x["target"]).alias("targets"))
    share = F.when(F.col("invoice_total") > 0, F.coalesce(F.col("tax").cast("double"), F.lit(0.0)) / F.col("invoice_total").cast("double")).otherwise(FALLBACK_TAX)
    known = wanted.join(invoices.select("invoice_id", F.col("charges").cast("array<double>").alias("charges"), share.alias("tax_share")), "invoice_id", "left").fillna({"tax_share": FALLBACK_TAX})
    columns = ["seq", "description", "tariff_code", "quantity", "unit_cost", "total_cost"]
    rows = items.select("invoice_id", "seq", "description", "tariff_code", *[F.col(c).cast("double").alias(c) for c in columns[3:]]).join(known, "invoice_id")

    def step(groups: list[list[tuple]]) -> Iterator[tuple]:
        return chain.from_iterable(answered([_split(group, len(group[0][7])) for group in groups]))

    out = "invoice_id long, declaration int, seq int, quantity double, unit_cost double, total_cost double, strategy string"
    return streamed_together(rows, "invoice_id", ["invoice_id", *columns, "targets", "charges", "tax_share"], ["seq"], step, out)


def declaration_totals(assigned: DataFrame, declarations: DataFrame, invoices: DataFrame) -> DataFrame:
    """Of each declaration of a split invoice: items, items_total, its share of the invoice's total, and whether a charge is near its items with tax
    (null without charges for all). A declaration without items has an equal share."""
    money = lambda c: c.cast("decimal(18,2)")
    mine = assigned.groupBy("invoice_id", "declaration").agg(F.count("*").alias("items"), money(F.sum(money(F.col("total_cost")))).alias("items_total"))
    every = declarations.select("invoice_id", F.col("declaration").cast("int").alias("declaration")).join(mine, ["invoice_id", "declaration"], "left").fillna({"items": 0})
    every = every.withColumn("items_total", F.coalesce("items_total", money(F.lit(0))))
    w = Window.partitionBy("invoice_id")
    every = every.withColumns({"__n": F.count("*").over(w), "__all": F.sum("items_total").over(w)}).filter("__n > 1").join(invoices, "invoice_id")
    share = F.when((F.col("__all") > 0) & (F.col("items") > 0), F.col("items_total").cast("double") / F.col("__all").cast("double")).otherwise(1.0 / F.col("__n"))
    taxed = F.col("items_total").cast("double") + F.coalesce(F.col("tax").cast("double"), F.lit(0.0)) * F.when(F.col("__all") > 0, F.col("items_total").cast("double") / F.col("__all").cast("double")).otherwise(1.0 / F.col("__n"))
    off = F.array_min(F.transform("charges", lambda c: F.abs(c.cast("double") - taxed)))
    return every.select(
        "invoice_id", "declaration", "items", "items_total", F.round((F.col("invoice_total").cast("double") * share).cast("decimal(28,6)"), 2).cast("decimal(18,2)").alias("invoice_share"),
        F.when(F.size("charges") == F.col("__n"), off <= MOST_OFF).alias("charge_met"),
    )

"""Grouping, totals and reconciliation of invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions import money
from tradeloom.operators.common import dimension, winners

MONEY = "decimal(18,2)"


def _money(c: Column) -> Column:
    return c.cast(MONEY)


def ratio(a: Column, b: Column, kind: str = "decimal(18,4)") -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0)).cast(kind)


def by_tariff(items: DataFrame, all_rows: bool = True) -> DataFrame:
    """Items grouped by invoice and code (null: UNKNOWN): quantity, cost and average of billable rows; with ``all_rows`` also the
    count of all rows, their first place and the cost of others; without, groups have billable rows only and the first
    row's category."""
    code = F.coalesce("tariff_code", F.lit("UNKNOWN")).alias("tariff_code")
    counted = lambda c: F.sum(F.when(F.col("billable"), F.col(c)))
    rows = items if all_rows else items.filter("billable")
    groups = rows.groupBy("invoice_id", code).agg(
        F.coalesce(counted("quantity"), F.lit(0)).cast("decimal(18,4)").alias("quantity"),
        _money(F.coalesce(counted("total_cost"), F.lit(0))).alias("cost"),
        F.count("*").alias("item_count"),
        _money(F.coalesce(F.sum(F.when(~F.col("billable"), F.col("total_cost"))), F.lit(0))).alias("other_cost"),
        F.min("line").alias("first_line"),
    )
    groups = groups.withColumn("average", ratio(F.col("cost"), F.col("quantity")))
    return groups if all_rows else groups.drop("other_cost")


def group_and_details(items: DataFrame) -> DataFrame:
    """Group rows above their details, in one table (row_type group or detail), by grouping sets."""
    out = items.groupingSets([["invoice_id", "tariff_code"], ["invoice_id", "tariff_code", "line"]], "invoice_id", "tariff_code", "line").agg(
        F.sum("quantity").cast("decimal(18,4)").alias("quantity"), _money(F.sum("total_cost")).alias("cost"), F.count("*").alias("n"), F.grouping("line").alias("g")
    )
    label = F.when(F.col("n") > 1, F.concat(F.lit("(+"), F.col("n") - 1, F.lit(" more) ("), F.col("n"), F.lit(" items)"))).otherwise("")
    return out.select("invoice_id", "tariff_code", "line", F.when(F.col("g") == 1, "group").otherwise("detail").alias("row_type"), "quantity", "cost", F.when(F.col("g") == 1, label).alias("label"))


def items_total(items: DataFrame) -> DataFrame:
    return items.filter("billable").groupBy("invoice_id").agg(_money(F.sum("total_cost")).alias("items_total"))


def reconciled(invoices: DataFrame, items: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """invoice_id, items_total, adjustments, net, variance, balanced, and which one amount explains the variance.

    Invoices without items count as 0; the variance is 0 where the total is missing or 0.
    """
    adjust = F.col("freight") + F.col("insurance") + F.col("tax") + F.col("other_cost") - F.col("discount") - F.col("free_shipping")
    out = invoices.join(items_total(items), "invoice_id", "left").withColumn("items_total", F.coalesce("items_total", F.lit(0).cast(MONEY)))
    out = out.withColumn("adjustments", _money(adjust)).withColumn("net", _money(F.col("items_total") + F.col("adjustments")))
    out = out.withColumn("variance", F.when(F.coalesce("invoice_total", F.lit(0)) == 0, F.lit(0).cast(MONEY)).otherwise(_money(F.col("invoice_total") - F.col("net"))))
    candidates = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("freight", "insurance", "tax", "other_cost", "discount")])
    explains = F.filter(candidates, lambda c: (F.abs(c["value"]) > 0) & (F.abs(c["value"] - F.abs("variance")) <= tolerance))
    return out.select("invoice_id", "items_total", "adjustments", "net", "variance", (F.abs("variance") <= tolerance).alias("balanced"), F.get(explains, 0)["name"].alias("explained_by"))


def grand_totals(reconciliation: DataFrame, invoices: DataFrame) -> DataFrame:
    """Sums of net and variance for each client and over all (client null), by rollup."""
    joined = reconciliation.join(invoices.select("invoice_id", "client_id"), "invoice_id")
    return joined.rollup("client_id").agg(_money(F.sum("net")).alias("net"), _money(F.sum("variance")).alias("variance"), F.count("*").alias("invoices"))


def variance_buckets(reconciliation: DataFrame) -> DataFrame:
    v = F.abs("variance")
    bucket = F.when(v <= 0.01, "balanced").when(v <= 0.5, "rounding").when(v <= 100, "small").when(v <= 10000, "medium").otherwise("large")
    return reconciliation.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), _money(F.sum(v)).alias("total"))


def neutral_credits(invoices: DataFrame) -> DataFrame:
    """Credits that pay the whole invoice are no discount: within 0.50 of the subtotal they become 0 and the total is what is due."""
    paid = F.col("credits") >= F.col("subtotal") - 0.50
    due = _money(F.col("subtotal") + F.col("tax") + F.col("shipping") - F.col("discount"))
    return invoices.withColumn("invoice_total", F.when(paid, due).otherwise(F.col("invoice_total"))).withColumn("credits", F.when(paid, F.lit(0).cast(MONEY)).otherwise(F.col("credits")))


def weighted_rate(items: DataFrame, rates: DataFrame, default: float = 0.20) -> DataFrame:
    """invoice_id and the cost-weighted duty rate (6 decimals), ``default`` where a code has none or nothing costs anything."""
    joined = items.join(dimension(rates.select("tariff_code", F.col("rate").cast("decimal(10,6)"))), "tariff_code", "left")
    rate = F.coalesce("rate", F.lit(str(default)).cast("decimal(10,6)"))
    sums = joined.groupBy("invoice_id").agg(F.sum((F.col("total_cost") * rate).cast("decimal(24,8)")).alias("weighted"), F.sum("total_cost").alias("cost"))
    share = F.coalesce(F.try_divide(F.col("weighted").cast("double"), F.col("cost").cast("double")), F.lit(default))
    return sums.select("invoice_id", F.round(share.cast("decimal(20,10)"), 6).cast("double").alias("rate"))


def estimated_duties(invoices: DataFrame, rates: DataFrame) -> DataFrame:
    """Duties of each invoice: items, freight and insurance at the invoice's rate, every step rounded."""
    cif = F.col("items_total") + F.col("freight") + F.col("insurance")
    return invoices.join(rates, "invoice_id").select("invoice_id", *[c.alias(n) for n, c in money.duties(cif, F.col("rate")).items()])


def declared_check(rows: DataFrame, declared: str, estimated: str, most: float = 0.50) -> DataFrame:
    """``rows`` with a finding: no declared amount, or one more than half off."""
    off = F.abs(F.col(declared) - F.col(estimated)) / F.greatest(F.col(estimated), F.lit(1))
    return rows.withColumn("finding", F.when(F.col(declared).isNull(), "MISSING_DECLARED").when(off > most, "DECLARED_OFF"))


def prorated(rows: DataFrame, group: str, amount: Column, weight: str, name: str) -> DataFrame:
    """``rows`` with a share of the group's amount by weight (2 decimals), and the residual that rounding leaves in the group.

    A group of no weight shares equally. Sums are pre-aggregated and joined, so one large group isn't one task's window.
    """
    sums = rows.groupBy(group).agg(F.sum(weight).alias("__weight"), F.count("*").alias("__n"))
    out = rows.join(sums, group).withColumn("__amount", amount.cast("decimal(18,4)"))
    # narrow operands leave the quotient enough decimals to round once
    exact = F.col("__amount").cast("decimal(12,4)") * F.col(weight).cast("decimal(16,2)") / F.col("__weight").cast("decimal(20,2)")
    share = F.when(F.col("__weight") > 0, exact).otherwise(F.col("__amount") / F.col("__n"))
    out = out.withColumn(name, F.round(share.cast("decimal(28,10)"), 2).cast(MONEY))
    given = out.groupBy(group).agg(F.sum(name).alias("__given"))
    return out.join(given, group).withColumn("residual", _money(F.col("__amount") - F.col("__given"))).drop("__weight", "__n", "__amount", "__given")


def apportioned(rows: DataFrame, markup: float = 0.5) -> DataFrame:
    """invoice_id, line, landed and price: each item's share of its code's tax and of the invoice's overhead, then a markup."""
    by_group = rows.groupBy("invoice_id", "tariff_code").agg(F.sum("total_cost").alias("group_cost"))
    by_invoice = rows.groupBy("invoice_id").agg(F.sum("total_cost").alias("invoice_cost"))
    out = rows.join(by_group, ["invoice_id", "tariff_code"]).join(by_invoice, "invoice_id")
    tax = ratio(F.col("group_tax") * F.col("total_cost"), F.col("group_cost"), "decimal(18,6)")
    overhead = ratio(F.col("overhead") * F.col("total_cost"), F.col("invoice_cost"), "decimal(18,6)")
    landed = (F.col("total_cost") + tax + overhead).cast("decimal(18,6)")
    return out.select(*rows.columns, landed.alias("landed"), F.round((landed * F.lit(str(1 + markup)).cast("decimal(6,2)")).cast("decimal(24,8)"), 2).cast(MONEY).alias("price"))


def rule_candidates(corrections: DataFrame, key: str, code: str, text: str, least_rows: int = 3, least_share: float = 0.6, most: int = 5) -> DataFrame:
    """key, code, n and the words that at least ``least_share`` of a group's texts have, of groups of ``least_rows`` or more."""
    groups = corrections.groupBy(key, code).agg(F.count("*").alias("n")).filter(F.col("n") >= least_rows)
    each = corrections.select(key, code, F.explode(F.array_distinct(F.split(F.lower(text), r"\s+"))).alias("word")).filter((F.length("word") >= 3) & ~F.col("word").rlike("^[0-9]+$"))
    common = each.groupBy(key, code, "word").agg(F.count("*").alias("has")).join(groups, [key, code]).filter(F.col("has") >= least_share * F.col("n"))
    ranked = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("has")).alias("h"), "word"))), 1, most), lambda w: w["word"])
    return common.groupBy(key, code).agg(F.first("n").alias("n"), F.array_join(ranked, " ").alias("words"))


def shipment_summary(shipments: DataFrame, items: DataFrame) -> DataFrame:
    """Per shipment: items, assessed, agreeing, and accuracy in per cent (1 decimal), null where nothing is assessed."""
    assessed = F.col("officer_code").isNotNull() & (F.col("officer_code") != "")
    sums = items.groupBy("shipment_id").agg(
        F.count("*").alias("items"), F.sum(assessed.cast("int")).alias("assessed"), F.sum((assessed & (F.col("pipeline_code") == F.col("officer_code"))).cast("int")).alias("agree")
    )
    out = shipments.join(sums, "shipment_id", "left").fillna(0, ["items", "assessed", "agree"])
    return out.select("shipment_id", "items", "assessed", "agree", F.round((100 * F.try_divide(F.col("agree"), F.col("assessed"))).cast("decimal(18,6)"), 1).cast("double").alias("accuracy_pct"))


def source_accuracy(items: DataFrame) -> DataFrame:
    agree = (F.col("pipeline_code") == F.col("officer_code")).cast("int")
    return items.filter(F.col("officer_code").isNotNull()).groupBy("source").agg(
        F.count("*").alias("n"),
        F.round((100 * F.sum(agree) / F.count("*")).cast("decimal(18,6)"), 1).cast("double").alias("accuracy_pct"),
        F.round(F.avg(F.col("confidence").cast("decimal(10,6)")).cast("decimal(18,6)"), 3).cast("double").alias("avg_confidence"),
    )


def tax_pivot(items: DataFrame, codes: list[str]) -> DataFrame:
    """Tax lines of each item as columns, one for each code in ``codes``."""
    return items.groupBy("item_id").pivot("tax_code", codes).agg(_money(F.sum("amount")))


def closest_charge(charges: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Of each key's charges, the one nearest its target; the smaller of two as near."""
    joined = charges.join(targets, key)
    return winners(joined.withColumn("gap", F.abs(F.col("charge") - F.col("target"))), [key], F.col("gap"), F.col("charge")).select(key, "charge", "gap")


def salvaged_total(rows: DataFrame) -> DataFrame:
    """A missing total from the subtotal and the adjustments, else from the items; ``uncertain`` if it was made up."""
    adjust = F.coalesce("adjustments", F.lit(0))
    made = F.coalesce(F.col("subtotal") + adjust, F.col("items_total") + adjust)
    return rows.withColumn("uncertain", F.col("invoice_total").isNull()).withColumn("invoice_total", F.coalesce("invoice_total", _money(made)))


def first_row_only(items: DataFrame, columns: list[str]) -> DataFrame:
    """Invoice-level columns on the invoice's first row, null on others."""
    w = Window.partitionBy("invoice_id").orderBy("seq")
    first = F.row_number().over(w) == 1
    return items.select(*[c for c in items.columns if c not in columns], *[F.when(first, F.col(c)).alias(c) for c in columns])

"""Lookups with fallbacks, extraction of fields, repairs of recognised amounts, and the state of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.operators.common import contained_in, dimension, named_in, winners


def sku_classified(skus: DataFrame, assessed: DataFrame, aliases: DataFrame) -> DataFrame:
    """``skus`` with code and source: the latest assessed code, else the last enabled alias that the description contains."""
    latest = winners(assessed, ["sku"], F.col("created_at").desc(), F.col("id").desc()).select("sku", F.col("code").alias("__assessed"))
    texts = skus.select("description").distinct().withColumn("__text", F.lower("description"))
    named = aliases.filter("enabled").select("id", F.col("code").alias("__alias"), F.lower("alias").alias("__part"))
    last = winners(contained_in(named, texts, "__part", "__text"), ["description"], F.col("id").desc()).select("description", "__alias")
    out = skus.join(latest, "sku", "left").join(last, "description", "left")
    source = F.when(F.col("__assessed").isNotNull(), "assessed").when(F.col("__alias").isNotNull(), "alias")
    return out.select(*skus.columns, F.coalesce("__assessed", "__alias").alias("code"), source.alias("source"))


def with_aliases(codes: DataFrame, aliases: DataFrame) -> DataFrame:
    """``codes`` (code, ...) with their enabled aliases in one string, in order of the alias; empty if there's none."""
    listed = aliases.filter("enabled").groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("alias")), ", ").alias("aliases"))
    return codes.join(listed, "code", "left").fillna("", ["aliases"])


def first_known(rows: DataFrame, sources: list[str], dim: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """``rows`` with ``value`` for the first of several columns that the dimension knows, else ``default``."""
    known = dimension(dim.select(F.lower(key).alias("__key"), F.col(value).alias("__value")))
    out = rows
    for i, s in enumerate(sources):
        out = out.withColumn("__key", F.lower(F.trim(s))).join(known.withColumnRenamed("__value", f"__v{i}"), "__key", "left").drop("__key")
    return out.select(*rows.columns, F.coalesce(*[F.col(f"__v{i}") for i in range(len(sources))], F.lit(default)).alias(value))


def supplier_found(names: DataFrame, suppliers: DataFrame) -> DataFrame:
    """name and supplier_id: by code, by name, else the first supplier whose name is part of it or the other way round."""
    s = suppliers.select("supplier_id", F.lower("name").alias("__name"), F.lower("code").alias("__code"))
    wanted = names.select("name").distinct().withColumn("__n", F.lower(F.trim("name")))
    exact = wanted.join(s, F.col("__n") == F.col("__code")).select("name", "supplier_id", F.lit(1).alias("tier"))
    exact = exact.unionByName(wanted.join(s, F.col("__n") == F.col("__name")).select("name", "supplier_id", F.lit(2).alias("tier")))
    rest = wanted.join(exact.select("name").distinct(), "name", "left_anti")
    # names of one list may have all of their grams in common
    both = named_in(s, rest, "__name", "__n").select("name", "supplier_id").union(named_in(rest, s, "__n", "__name").select("name", "supplier_id"))
    part = both.distinct().withColumn("tier", F.lit(3))
    return winners(exact.unionByName(part), ["name"], F.col("tier"), F.col("supplier_id"))


def bundles_inherit(bundles: DataFrame, items: DataFrame) -> DataFrame:
    """bundle_id and code: that of the first item (seq) that a member names or, ending in ``*``, begins.

    Items are reduced to the first of each SKU, and those to the first of each beginning, before members meet them.
    """
    members = bundles.select("bundle_id", F.posexplode("members").alias("place", "member"))
    star = F.col("member").endswith("*")
    first = items.filter("sku IS NOT NULL").groupBy("sku").agg(F.min(F.struct("seq", "code")).alias("first"))
    heads = first.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("sku")), lambda n: F.left("sku", n))).alias("__p"), "first").groupBy("__p").agg(F.min("first").alias("first"))
    exact = members.filter(~star).join(first, F.col("member") == F.col("sku"))
    begun = members.filter(star).withColumn("__p", F.regexp_replace("member", r"\*$", "")).join(heads, "__p")
    columns = ["bundle_id", "place", "first.seq", "first.code"]
    return winners(exact.select(columns).unionByName(begun.select(columns)), ["bundle_id"], F.col("place"), F.col("seq")).select("bundle_id", "code")


def recap_matched(recap: DataFrame, invoices: DataFrame, lengths: tuple[int, ...] = (15, 14, 13)) -> DataFrame:
    """ref and invoice_ref: equal, else equal when cut to one of ``lengths``; misses of either side have a null."""
    r, i = recap.select("ref").distinct(), invoices.select("invoice_ref").distinct()
    pairs = r.join(i, F.col("ref") == F.col("invoice_ref")).select("ref", "invoice_ref", F.lit(0).alias("way"))
    for n, length in enumerate(lengths, 1):
        # of the invoices with one beginning the first is the best of this way
        first = i.filter(F.length("invoice_ref") >= length).groupBy(F.substring("invoice_ref", 1, length).alias("__c")).agg(F.min("invoice_ref").alias("invoice_ref"))
        cut = r.filter(F.length("ref") >= length).withColumn("__c", F.substring("ref", 1, length)).join(first, "__c")
        pairs = pairs.unionByName(cut.select("ref", "invoice_ref", F.lit(n).alias("way")))
    best = winners(pairs, ["ref"], F.col("way"), F.col("invoice_ref"))
    missed_r = r.join(best, "ref", "left_anti").select("ref", F.lit(None).cast("string").alias("invoice_ref"), F.lit(None).cast("int").alias("way"))
    missed_i = i.join(best, "invoice_ref", "left_anti").select(F.lit(None).cast("string").alias("ref"), "invoice_ref", F.lit(None).cast("int").alias("way"))
    return best.unionByName(missed_r).unionByName(missed_i)


def cached(terms: DataFrame, cache: DataFrame) -> DataFrame:
    """term, code and confidence: 0.8 for the same key, else 0.7 for the first cached key that is part of it or has it as a part."""
    exact = terms.join(cache.withColumnRenamed("key", "term"), "term").select("term", "code", F.lit(0.8).alias("confidence"))
    rest = terms.join(exact, "term", "left_anti")
    part = contained_in(cache, rest, "key", "term").select("term", "key", "code").union(contained_in(rest, cache, "term", "key").select("term", "key", "code"))
    return exact.unionByName(winners(part, ["term"], F.col("key")).select("term", "code", F.lit(0.7).alias("confidence")))


def variant_picked(variants: DataFrame, least_chars: int = 0, least_prices: int = 0) -> DataFrame:
    """doc_id and the best reading of each document: by engine priority, prices, length, then the smallest id."""
    prices = F.regexp_count("text", F.lit(r"\d+\.\d{2}"))
    fit = variants.withColumn("prices", prices).withColumn("chars", F.length("text")).filter((F.col("chars") >= least_chars) & (F.col("prices") >= least_prices))
    return winners(fit, ["doc_id"], F.col("priority").desc(), F.col("prices").desc(), F.col("chars").desc(), F.col("variant_id")).select("doc_id", "variant_id", "prices", "chars")


def field(text: Column, patterns: list[str], fallback: str | None = None) -> Column:
    """The first group of the first pattern that matches, else ``fallback``."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns], F.lit(fallback))


def field_sum(text: Column, patterns: list[str]) -> Column:
    """The sum of the amounts of all matches of all patterns."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]))
    amounts = F.transform(found, lambda m: F.coalesce(F.replace(m, F.lit(","), F.lit("")).try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")))
    return F.aggregate(amounts, F.lit(0).cast("decimal(28,2)"), lambda a, m: (a + m).cast("decimal(28,2)")).cast("decimal(18,2)")


def charges(text: Column, pattern: str = r"\$\s?(\d[\d,]*\.\d{2})") -> Column:
    """All amounts above 0, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda m: F.replace(m, F.lit(","), F.lit("")).cast("decimal(18,2)"))
    return F.filter(found, lambda m: m > 0)


def content_class(text: Column) -> Column:
    """What a page is, by rules in order."""
    low = F.lower(text)
    has = lambda *ws: [F.contains(low, F.lit(w)) for w in ws]
    every = lambda cs: F.greatest(*[(~c).cast("int") for c in cs]) == 0 if len(cs) > 1 else cs[0]
    return (
        F.when(every(has("recap", "total")), "recap")
        .when(every(has("freight", "invoice")), "freight")
        .when(low.rlike("declaration|customs entry"), "declaration")
        .when(F.contains(low, F.lit("manifest")), "manifest")
        .when(low.rlike("bill of lading|b/l no"), "bill_of_lading")
        .when(F.contains(low, F.lit("packing list")), "packing_list")
        .when(F.contains(low, F.lit("invoice")), "invoice")
        .otherwise("unknown")
    )


def arithmetic_fixed(items: DataFrame) -> DataFrame:
    """``items`` with quantity and unit cost that fit the total: the quantity becomes total / cost if that is whole, else the cost total /
    quantity if it changes by a quarter at most."""
    q, u, t = (F.col(c).cast("decimal(18,4)") for c in ("quantity", "unit_cost", "total_cost"))
    off = F.abs(q * u - t) > 0.01
    whole = F.try_divide(t, u)
    fits = (whole > 0) & (whole == F.round(whole, 0))
    cost = F.try_divide(t, q)
    near = F.abs(cost - u) <= 0.25 * u
    how = F.when(~off, "kept").when(fits, "quantity").when(near, "cost").otherwise("open")
    out = items.withColumn("how", how)
    return out.withColumn("quantity", F.when(F.col("how") == "quantity", F.round(whole, 0)).otherwise(q).cast("decimal(18,4)")).withColumn("unit_cost", F.when(F.col("how") == "cost", F.round(cost.cast("decimal(28,8)"), 2)).otherwise(u).cast("decimal(18,4)"))


def digit_fixed(rows: DataFrame, within: float = 0.02) -> DataFrame:
    """``rows`` (id, subtotal, tax, total) with the tax or else the total changed in one digit so that they add up, where they don't."""
    cents = lambda c: F.round(F.col(c) * 100, 0).cast("bigint")
    off = rows.withColumn("__s", cents("subtotal")).withColumn("__t", cents("tax")).withColumn("__o", cents("total"))
    open_ = F.abs(F.col("__s") + F.col("__t") - F.col("__o")) > within * 100
    place = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("p")
    moved = off.filter(open_).select("id", "__s", "__t", "__o", place).withColumn("w", F.pow(F.lit(10), F.col("p")).cast("bigint"))
    candidates = None
    for n, (what, value, target) in enumerate((("tax", F.col("__t"), F.col("__o") - F.col("__s")), ("total", F.col("__o"), F.col("__s") + F.col("__t")))):
        # the digit at a place must change by (target - value) / w, which is whole and stays within 0 to 9
        digit = F.floor(value / F.col("w")) % 10
        change = (target - value) / F.col("w")
        fits = (target >= 0) & (value >= F.col("w")) & (change == F.floor(change)) & (digit + change).between(0, 9) & (change != 0)
        part = moved.filter(fits).select("id", F.lit(n).alias("order"), F.lit(what).alias("fixed"), (target / 100).cast("decimal(18,2)").alias("value"), "p")
        candidates = part if candidates is None else candidates.unionByName(part)
    best = winners(candidates, ["id"], F.col("order"), F.col("p")).select("id", "fixed", "value")
    out = rows.join(best, "id", "left")
    return out.select("id", "subtotal", F.when(F.col("fixed") == "tax", F.col("value")).otherwise(F.col("tax")).alias("tax"), F.when(F.col("fixed") == "total", F.col("value")).otherwise(F.col("total")).alias("total"), "fixed")


def converted(items: DataFrame, rates: DataFrame, markers: Column) -> DataFrame:
    """``items`` in local currency where the document has at least two currency marks: money times the rate (4 decimals)."""
    out = items.join(dimension(rates), "currency", "left")
    rate = F.when((markers >= 2) & F.col("rate").isNotNull(), F.col("rate").cast("decimal(10,6)")).otherwise(F.lit(1).cast("decimal(10,6)"))
    return out.withColumn("unit_cost", F.round((F.col("unit_cost").cast("decimal(18,4)") * rate).cast("decimal(28,10)"), 4).cast("decimal(18,4)")).select(*items.columns)


def latest_status(updates: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The state of each key after partial updates: for each column the last value that isn't null, and the number of updates."""
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns]
    return updates.groupBy(key).agg(*newest, F.count("*").alias("updates"))


def resumable(states: DataFrame, statuses: list[str], most: int = 3) -> DataFrame:
    return states.filter(F.col("status").isin(statuses) & (F.col("retry_count") < most))


def totals_block(items: DataFrame) -> DataFrame:
    """Subtotals of an invoice's codes and of the invoice by grouping sets, and whether the groups add up to the details."""
    out = items.groupingSets([["invoice_id", "tariff_code"], ["invoice_id"]], "invoice_id", "tariff_code").agg(F.sum("total_cost").cast("decimal(18,2)").alias("subtotal"), F.count("*").alias("n"), F.grouping("tariff_code").alias("is_total"))
    groups = out.filter("is_total = 0").groupBy("invoice_id").agg(F.sum("subtotal").alias("__groups"))
    checked = out.filter("is_total = 1").join(groups, "invoice_id").select("invoice_id", (F.col("__groups") == F.col("subtotal")).alias("verified"))
    return out.join(checked, "invoice_id").select("invoice_id", "tariff_code", "subtotal", "n", F.when(F.col("is_total") == 1, F.col("verified")).alias("verified"))


def headers_recomputed(rows: DataFrame, group: str, order: str) -> DataFrame:
    """group, header and the sums of the details below each header row (is_header); details above the first header are left out."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("header", F.last(F.when(F.col("is_header"), F.col(order)), ignorenulls=True).over(w))
    return held.filter(~F.col("is_header") & F.col("header").isNotNull()).groupBy(group, "header").agg(F.sum("amount").cast("decimal(18,2)").alias("amount"), F.count("*").alias("n"))


def names_disagree(groups: DataFrame, bills: DataFrame, key: str) -> DataFrame:
    """Keys of which no group's name contains the bill's consignee or is contained in it."""
    pairs = bills.join(groups, key)
    agree = pairs.filter(F.contains(F.lower("name"), F.lower("consignee")) | F.contains(F.lower("consignee"), F.lower("name")))
    return bills.select(key).distinct().join(agree.select(key).distinct(), key, "left_anti")

"""Tariff classification: assessed history, rules, categories, and correction of codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions import codes
from tradeloom.functions.text import words
from tradeloom.operators.common import BROADCAST_ROWS, bounded, contained_in, dimension, winners


@dataclass(frozen=True)
class Gates:
    """When an assessed entry counts (fixed values)."""

    exact_confidence: float = 0.60
    exact_count: int = 2
    coverage: float = 0.40
    shortest: int = 12
    overlap: float = 0.75
    overlap_confidence: float = 0.85
    overlap_count: int = 5
    common_words: int = 3


def majority_vote(rows: DataFrame, key: str, code: str, valid: DataFrame, refs: str, source: str, text: str, most_refs: int = 10) -> DataFrame:
    """key, code, count, total, confidence (3 decimals), sample (longest text), sources, refs of each key.

    The most frequent code wins; of equally frequent ones a code in ``valid`` (column code), then the smallest. Counted per
    key and code first, so a frequent key is spread over its codes and tasks.
    """
    counted = rows.groupBy(key, code).agg(
        F.count("*").alias("count"),
        F.max(F.struct(F.length(text).alias("n"), F.col(text).alias("text"))).alias("longest"),
        F.collect_set(source).alias("sources"),
        F.collect_set(refs).alias("refs"),
    )
    checked = counted.join(dimension(valid.select(F.col("code").alias(code)).distinct()).withColumn("is_valid", F.lit(1)), code, "left")
    totals = checked.groupBy(key).agg(
        F.min(F.struct((-F.col("count")).alias("c"), F.col("is_valid").isNull().alias("v"), F.col(code).alias("code"))).alias("best"),
        F.sum("count").alias("total"),
        F.max("longest").alias("longest"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))), 1, most_refs).alias("refs"),
    )
    count = -F.col("best.c")
    return totals.select(
        key, F.col("best.code").alias("code"), count.alias("count"), "total",
        F.round((count / F.col("total")).cast("decimal(18,6)"), 3).cast("double").alias("confidence"), F.col("longest.text").alias("sample"), "sources", "refs",
    )


def assessed_exact(keys: DataFrame, assessed: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """key, code, score, tier and seq (of the entry) of keys that an entry has word for word."""
    found = keys.join(assessed.withColumnRenamed("description_norm", "key"), "key").filter(
        (F.col("confidence") >= gates.exact_confidence) & (F.col("count") >= gates.exact_count)
    )
    return found.select("key", "code", F.least(F.lit(0.97), 0.90 + 0.07 * F.col("confidence")).alias("score"), F.lit("exact").alias("tier"), "seq")


def distinct_words(text: str) -> Column:
    return F.array_distinct(words(F.col(text)))


def _by_rare_words(keys: DataFrame, assessed: DataFrame, least: Column) -> DataFrame:
    """Pairs of keys and entries (seq, description_norm) that share ``least`` words (of the key's ``n``) or more, with ``common``.

    Of a key's words, all but the ``least`` - 1 most frequent ones are looked for: an entry that has none of them can't share enough. So the
    words that many rows have aren't joined unless a key has no others.
    """
    theirs = assessed.select("seq", "description_norm", distinct_words("description_norm").alias("has")).withColumn("word", F.explode("has"))
    often = theirs.groupBy("word").agg(F.count("*").alias("times"))
    ours = keys.select("key", distinct_words("key").alias("asked")).withColumn("n", F.size("asked")).withColumn("word", F.explode("asked"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("times", "word"))
    rare = ours.join(often, "word", "left").withColumn("times", F.coalesce("times", F.lit(0))).withColumn("at", rank).filter(F.col("at") <= F.col("n") - least + 1)
    pairs = rare.select("key", "n", "asked", "word").join(theirs, "word").dropDuplicates(["key", "seq"])
    return pairs.withColumn("common", F.size(F.array_intersect("asked", "has"))).filter(F.col("common") >= least).select("key", "n", "seq", "description_norm", "common")


def assessed_containment(keys: DataFrame, assessed: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """key, code, score, tier and seq where one of key and entry contains the other, as text; both have two words, the shorter covers enough
    of the longer; the largest coverage wins, then the first entry. The score is by the entry's confidence."""
    ours = keys.select("key").distinct().filter(F.size(words(F.col("key"))) >= 2)
    theirs = assessed.select("seq", "description_norm", "code", "confidence").filter(F.size(words(F.col("description_norm"))) >= 2)
    columns = ["key", "seq", "description_norm", "code", "confidence"]
    pairs = contained_in(theirs, ours, "description_norm", "key", gates.shortest).select(columns).union(contained_in(ours, theirs, "key", "description_norm", gates.shortest).select(columns))
    a, b = F.length("key"), F.length("description_norm")
    close = pairs.withColumn("coverage", F.least(a, b) / F.greatest(a, b)).filter(F.col("coverage") >= gates.coverage)
    best = winners(close, ["key"], F.col("coverage").desc(), F.col("seq"))
    return best.select("key", "code", F.least(F.lit(0.92), 0.85 + 0.07 * F.col("confidence")).alias("score"), F.lit("containment").alias("tier"), "seq")


def assessed_overlap(keys: DataFrame, assessed: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """key, code, score, tier and seq by shared words: three at least, and a mean share of both sides above the gate."""
    e = assessed.filter((F.col("confidence") >= gates.overlap_confidence) & (F.col("count") >= gates.overlap_count))
    # the key's own share is over twice the gate less one, as the entry's is one at most
    least = F.greatest(F.lit(gates.common_words), F.floor(F.col("n") * (2 * gates.overlap - 1)).cast("int") + 1)
    pairs = _by_rare_words(keys, e, least)
    share = (F.col("common") / F.col("n") + F.col("common") / F.size(distinct_words("description_norm"))) / 2
    best = winners(pairs.withColumn("share", share).filter(F.col("share") > gates.overlap), ["key"], F.col("share").desc(), F.col("seq"))
    return best.join(e.select("seq", "code"), "seq").select("key", "code", F.least(F.lit(0.85), 0.75 + 0.10 * F.col("share")).alias("score"), F.lit("overlap").alias("tier"), "seq")


def assessed_lookup(
    keys: DataFrame, assessed: DataFrame, expected_chapter: DataFrame | None = None, gates: Gates = Gates(), valid: DataFrame | None = None, invalid: DataFrame | None = None
) -> DataFrame:
    """key, code, score and tier: each tier's one winner has its code corrected (where ``valid`` and ``invalid`` are given), is gated by the
    key's expected chapter, if it has one, and by ``cross_validated``. The first tier that passes counts; a winner that fails gives way to
    the next tier, not to a runner-up."""
    tiers = assessed_exact(keys, assessed, gates).withColumn("n", F.lit(1))
    tiers = tiers.unionByName(assessed_containment(keys, assessed, gates).withColumn("n", F.lit(2)))
    tiers = tiers.unionByName(assessed_overlap(keys, assessed, gates).withColumn("n", F.lit(3)))
    if valid is not None and invalid is not None:
        tiers = corrected(tiers, valid, invalid).withColumn("code", F.col("corrected")).drop("corrected", "how")
    if expected_chapter is not None:
        tiers = tiers.join(expected_chapter, "key", "left").filter(F.col("chapter").isNull() | (F.substring("code", 1, 2) == F.col("chapter"))).drop("chapter")
    return winners(cross_validated(tiers, assessed), ["key"], F.col("n")).select("key", "code", "score", "tier")


def cross_validated(candidates: DataFrame, assessed: DataFrame, least_share: float = 0.30) -> DataFrame:
    """``candidates`` (key, code, seq of the matched entry) whose chapter stands up to two checks.

    References: an entry that begins with a digit, shares a reference with the matched one, counts as much at least and has another chapter
    refutes it. Siblings: entries that share two words and three quarters of the key's, weighted by count, refute it if another chapter
    leads (of equal ones that with the first entry) and the candidate's has a share below ``least_share``.
    """
    marked = candidates.withColumn("__chapter", F.substring("code", 1, 2))
    numbered = assessed.filter(F.col("description_norm").rlike("^[0-9]")).select(F.explode("refs").alias("__ref"), F.substring("code", 1, 2).alias("__other"), "count")
    rivals = numbered.groupBy("__ref", "__other").agg(F.max("count").alias("__most"))
    own = assessed.select("seq", F.col("count").alias("__own"), F.explode("refs").alias("__ref"))
    met = marked.select("key", "seq", "__chapter").distinct().join(own, "seq").join(rivals, "__ref")
    refuted = met.filter((F.col("__other") != F.col("__chapter")) & (F.col("__most") >= F.col("__own"))).select("key", "seq", "__chapter").distinct()
    left = marked.join(refuted, ["key", "seq", "__chapter"], "left_anti")

    least = F.greatest(F.lit(2), F.ceil(F.col("n") * 0.75).cast("int"))
    near = _by_rare_words(candidates.select("key").distinct(), assessed, least).filter("n >= 2")
    votes = near.join(assessed.select("seq", F.substring("code", 1, 2).alias("__chapter"), "count"), "seq").groupBy("key", "__chapter").agg(F.sum("count").alias("weight"), F.min("seq").alias("first"))
    lead = votes.groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("w"), "first", F.col("__chapter").alias("chapter"))).alias("lead"), F.sum("weight").alias("all_votes"))
    own_votes = left.join(votes.select("key", "__chapter", "weight"), ["key", "__chapter"], "left").join(lead, "key", "left")
    minor = F.col("lead").isNotNull() & (F.col("lead.chapter") != F.col("__chapter")) & (F.coalesce("weight", F.lit(0)) < least_share * F.col("all_votes"))
    return own_votes.filter(~F.coalesce(minor, F.lit(False))).select(*candidates.columns)


def _holds(text: Column, pattern: Column, boundary: int) -> Column:
    """Whether the text has the pattern: as a whole word if it is shorter than ``boundary``, as a part otherwise."""
    quoted = F.regexp_replace(pattern, r"([^A-Za-z0-9 ])", r"\\$1")
    whole = F.rlike(text, F.concat(F.lit(r"\b"), quoted, F.lit(r"\b")))
    return F.when(F.length(pattern) < boundary, whole).otherwise(F.contains(text, pattern))


def rule_match(keys: DataFrame, rules: DataFrame, boundary: int = 7, chapters: DataFrame | None = None) -> DataFrame:
    """key, rule_id, code, category and confidence of the first rule by priority and order.

    rules: seq, id, code, category, patterns, exclude, priority, confidence; exclusions are plain parts and come first. A rule
    whose chapter isn't the key's expected one doesn't stop the search. boundary 0: all patterns are plain parts. Keys
    should be distinct texts (see ``fanned_out``), rules a dimension of checked size.
    """
    text = F.lower("key")
    excluded = F.exists("exclude", lambda p: F.contains(text, F.lower(p)))
    matched = F.exists("patterns", lambda p: _holds(text, F.lower(p), boundary))
    pairs = keys.crossJoin(bounded(rules)).filter(~excluded & matched)
    if chapters is not None:
        pairs = pairs.join(chapters, "key", "left").filter(F.col("chapter").isNull() | (F.substring("code", 1, 2) == F.col("chapter")))
    return winners(pairs, ["key"], F.col("priority").desc(), F.col("seq")).select("key", F.col("id").alias("rule_id"), "code", "category", "confidence")


def category_scores(keys: DataFrame, categories: DataFrame, least: int = 2) -> DataFrame:
    """key, code, category and confidence of the best category: a point for each keyword, two for materials and items."""
    text = F.lower("key")
    points = lambda name, each: F.size(F.filter(name, lambda w: F.contains(text, F.lower(w)))) * each
    scored = keys.crossJoin(bounded(categories)).withColumn("points", points("keywords", 1) + points("materials", 2) + points("items", 2))
    best = winners(scored.filter(F.col("points") >= least), ["key"], F.col("points").desc(), F.col("seq"))
    return best.select("key", "code", "category", "points", F.least(F.lit(0.75), 0.5 + 0.05 * F.col("points")).alias("confidence"))


def contained_value(keys: DataFrame, brands: DataFrame, confidence: float = 0.7) -> DataFrame:
    """key, brand and code of the first brand that the key contains."""
    found = keys.crossJoin(bounded(brands)).filter(F.contains(F.lower("key"), F.lower("brand")))
    return winners(found, ["key"], F.col("seq")).select("key", "brand", "code", F.lit(confidence).alias("confidence"))


def corrected(rows: DataFrame, valid: DataFrame, invalid: DataFrame, code: str = "code") -> DataFrame:
    """``rows`` with ``corrected`` and ``how``: what the invalid list maps it to, whatever that is; else valid as it is; else its subheading with
    00, mapped again if that is on the invalid list; else the subheading's last code that ends in 90, or its last; else the same by
    heading, where 00 counts as 90 does; else the code itself. Codes on the invalid list are no substitutes. UNKNOWN and no code stay."""
    leaves = valid.select("code").distinct()
    mapped = invalid.select("code", "correct_code").dropDuplicates(["code"])
    small = leaves.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and mapped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hinted = F.broadcast if small else lambda df: df
    usable = leaves.join(hinted(mapped), "code", "left_anti")

    def last(n: int, *ends: str) -> DataFrame:
        general = F.max(F.when(F.substring("code", -2, 2).isin(*ends), F.col("code")))
        return usable.groupBy(F.substring("code", 1, n).alias(f"__p{n}")).agg(F.coalesce(general, F.max("code")).alias(f"__near{n}"))

    own = F.col(code)
    out = rows.withColumn("__code", own).withColumn("__zero", F.concat(F.substring(own, 1, 6), F.lit("00"))).withColumn("__p6", F.substring(own, 1, 6)).withColumn("__p4", F.substring(own, 1, 4))
    for key in ("__code", "__zero"):
        out = out.join(hinted(mapped.select(F.col("code").alias(key), F.col("correct_code").alias(f"{key}_mapped"))), key, "left")
        out = out.join(hinted(leaves.select(F.col("code").alias(key), F.lit(True).alias(f"{key}_ok"))), key, "left")
    out = out.join(hinted(last(6, "90")), "__p6", "left").join(hinted(last(4, "90", "00")), "__p4", "left")
    steps = [
        ("none", F.when(own.isNull() | own.isin("", "UNKNOWN"), own)),
        ("mapped", F.col("__code_mapped")),
        ("valid", F.when(F.col("__code_ok"), own)),
        ("zero mapped", F.when(F.col("__zero_ok"), F.col("__zero_mapped"))),
        ("zero", F.when(F.col("__zero_ok"), F.col("__zero"))),
        ("subheading", F.col("__near6")),
        ("heading", F.col("__near4")),
    ]
    how = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in steps], F.lit("none"))
    return out.select(*rows.columns, F.coalesce(*[c for _, c in steps], own).alias("corrected"), how.alias("how"))


def walked_up(rows: DataFrame, dim: DataFrame, value: str, code: str = "code") -> DataFrame:
    """``rows`` with the value of the nearest level (leaf, subheading, heading, chapter) that has one, and the level."""
    have = dim.filter(F.col(value).isNotNull()).select(F.col(code).alias("__at"), F.col(value).alias("__value")).distinct()
    out = rows
    for n in (8, 6, 4, 2):
        at = F.rpad(F.substring(F.col(code), 1, n), 8, "0")
        out = out.withColumn("__at", at).join(dimension(have.withColumnRenamed("__value", f"__v{n}")), "__at", "left").drop("__at")
    found = [F.col(f"__v{n}") for n in (8, 6, 4, 2)]
    level = F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for v, n in zip(found, (8, 6, 4, 2), strict=True)])
    return out.select(*rows.columns, F.coalesce(*found).alias(value), level.alias("level"))


def category_label(rows: DataFrame, dim: DataFrame, code: str = "code") -> DataFrame:
    """``rows`` with a category: a concrete leaf's own description; ``Other`` and the parent's for a general leaf; the parent's for a
    missing one. Never a sibling's."""
    general = F.lower(F.trim("description")).isin("other", "others", "n.e.s.", "other:")
    named = dim.filter(~general & F.col("description").isNotNull()).select("code", "description")
    leaf = dim.select(F.col("code").alias(code), F.col("description").alias("__leaf"), general.alias("__general"))
    out = walked_up(rows.join(dimension(leaf), code, "left"), named, "description", code)
    other = F.concat(F.lit("Other "), F.col("description"))
    label = F.when(F.col("__general") & ~F.upper("description").startswith("OTHER"), other).otherwise(F.col("description"))
    return out.select(*rows.columns, label.alias("category"), "level")


def officer_status(rows: DataFrame, ours: str, theirs: str) -> DataFrame:
    return rows.withColumn("match_status", codes.match_status(F.col(ours), F.col(theirs))).withColumn("code_changed", F.col("match_status") != "exact_match")

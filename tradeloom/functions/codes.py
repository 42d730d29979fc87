"""Codes: SKUs, references, tariff codes and rates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sku(value: Column) -> Column:
    return F.upper(F.translate(F.coalesce(value, F.lit("")), "- ", ""))


def reference(value: Column) -> Column:
    """An invoice reference without INV and leading zeros, or as it is if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(value, "^(?i)INV[-#]?0*", ""), F.lit("")), value)


def file_reference(path: Column) -> Column:
    """A file's name without folder, extension and copy number."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[A-Za-z0-9]+$", "")
    return F.trim(F.regexp_replace(name, r" \(\d+\)$", ""))


def is_leaf(code: Column) -> Column:
    return F.coalesce(code.rlike("^[0-9]{8}$"), F.lit(False))


def levels(code: Column) -> list[Column]:
    """Chapter, heading, subheading and leaf."""
    return [F.substring(code, 1, n).alias(name) for n, name in ((2, "chapter"), (4, "heading"), (6, "subheading"), (8, "leaf"))]


def chapter_ok(code: Column) -> Column:
    """Chapters 1 to 97, of which 77 is reserved."""
    chapter = F.try_to_number(F.substring(code, 1, 2), F.lit("99")).cast("int")
    return is_leaf(code) & chapter.between(1, 97) & (chapter != 77)


def rate(value: Column) -> Column:
    """A duty rate as a share: free is 0, letters have none, a range counts by its upper end, numbers over 1 are per cent."""
    text = F.trim(value)
    number = text.try_cast("double")
    upper = F.trim(F.get(F.split(F.replace(text, F.lit("%"), F.lit("")), "-"), 1)).try_cast("double")
    return (
        F.when(F.lower(text).isin("free", "nil"), F.lit(0.0))
        .when(text.rlike("^[A-Za-z]*$"), F.lit(None))
        .when(F.contains(text, F.lit("-")) & F.contains(text, F.lit("%")), upper / 100)
        .when(number <= 1, number)
        .otherwise(number / 100)
    )


#: Kinds of sets by SKU prefix, and whether they are billed; and what marks a set in a description (fixed values).
BUNDLE_PREFIXES = (("ST-", "starter_kit", False), ("DP-", "display", True), ("TST-", "tester_set", True), ("T-", "tester", True))
BUNDLE_MARKS = ("SET FOR ", "KIT FOR ", "STARTER KIT", "DISPLAY SET")


def bundle_type(sku_value: Column, description: Column) -> Column:
    """The kind of set that an item is, by its SKU first; null for an ordinary item."""
    upper = F.upper(F.coalesce(sku_value, F.lit("")))
    marked = F.upper(F.coalesce(description, F.lit(""))).rlike("|".join(BUNDLE_MARKS))
    return F.coalesce(*[F.when(upper.startswith(p), kind) for p, kind, _ in BUNDLE_PREFIXES], F.when(marked, "set"))


def bundle_billable(kind: Column) -> Column:
    """Sets whose parts are billed one by one don't count; null (no set) is billed."""
    return ~F.coalesce(kind.isin("set", *[k for _, k, billed in BUNDLE_PREFIXES if not billed]), F.lit(False))


def bundle_members(reference_value: Column) -> Column:
    """``MFHG01-04`` lists MFHG01 to MFHG04; other references stand for themselves and all that begin with them (``*``)."""
    base, first, last = (F.regexp_extract(reference_value, r"^([A-Z]+)(\d+)-(\d+)$", i) for i in (1, 2, 3))
    numbers = F.sequence(first.try_cast("int"), last.try_cast("int"))
    ordered = first.try_cast("int") <= last.try_cast("int")
    return F.when((base != "") & ordered, F.transform(numbers, lambda n: F.concat(base, F.lpad(n.cast("string"), F.length(first), F.lit("0"))))).otherwise(
        F.array(F.concat(reference_value, F.lit("*")))
    )


def match_status(ours: Column, theirs: Column) -> Column:
    """How far two codes agree: exact, subheading, heading or not; two empty codes agree."""
    a, b = F.coalesce(ours, F.lit("")), F.coalesce(theirs, F.lit(""))
    return (
        F.when(a == b, "exact_match")
        .when(F.substring(a, 1, 6) == F.substring(b, 1, 6), "subheading_match")
        .when(F.substring(a, 1, 4) == F.substring(b, 1, 4), "heading_match")
        .otherwise("disagree")
    )


def params_hash(*values: Column) -> Column:
    """SHA-256 over values in a fixed order; null differs from empty."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(v.cast("string"), F.lit("\\N")) for v in values]), "\x1f").cast("binary"), 256)

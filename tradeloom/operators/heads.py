"""Fields of special documents: rates of currency converters, and heads of customs manifests and declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Currencies by their marks, as they are also misread, in the order in which pairs are tried; and the patterns below.
MARKS = {"CNY": r"(?:CNY|ONY|CINY|CTNY|CN¥|¥)", "USD": r"(?:USD|USO|USB|US\$|\$)", "EUR": r"(?:EUR|EURO)", "GBP": r"(?:GBP|£)"}
PAIRS = (("CNY", "USD"), ("EUR", "USD"), ("GBP", "USD"), ("USD", "CNY"))
MOST_RATE = 100_000.0
#: Amounts of two lines are a rate if their quotient is between these.
LEAST_QUOTIENT, MOST_QUOTIENT = 0.05, 0.50
TWO_AMOUNTS = r"([\d.,]+)\s+CHINESE\s*YUAN[^\n]*\n(?:[^\n]*\n){0,3}?[^\n]*?([\d.,]+)[^\n]*?US\s*DOLLAR"
DATES = (r"([A-Z][a-z]{2}\s+\d{1,2},?\s+\d{4}[^\n]*UTC?)", r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2})", r"([A-Z][a-z]{2}\s+\d{1,2},?\s+\d{4})")


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null if nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def conversion_rate(text: Column) -> Column:
    """source, target, rate, raw, samples and date of a converter's page; null where there is no rate.

    A stated rate (``1 CNY = 0.14 USD``, misread in known ways) comes first, by the order of pairs. Else amounts in yuan that have an amount in dollars
    in one of the next lines give quotients; the median of the plausible ones counts, rounded to eight decimals.
    """
    upper = F.upper(text)
    stated = []
    for source, target in PAIRS:
        pattern = rf"[1TIl]\s*{MARKS[source]}\s*[-=:~]\s*([0-9]+\.[0-9]{{3,}})\s*{MARKS[target]}"
        rate = _first(upper, pattern).try_cast("double")
        stated.append(F.when((rate > 0) & (rate < MOST_RATE), F.struct(F.lit(source).alias("source"), F.lit(target).alias("target"), rate.alias("rate"), _first(upper, pattern, 0).alias("raw"), F.lit(1).alias("samples"))))
    named = F.regexp_replace(F.regexp_replace(upper, "CHINOSE|CHINESE|SHINEWS|CHIRGES|CHINEWS", "CHINESE"), "USDOLLARS?", "US DOLLARS")
    whole, yuan, dollars = (F.regexp_extract_all(named, F.lit(TWO_AMOUNTS), F.lit(g)) for g in (0, 1, 2))
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("double")
    found = F.transform(F.arrays_zip(whole.alias("w"), yuan.alias("y"), dollars.alias("d")), lambda m: F.struct(F.when((number(m["y"]) > 0) & (number(m["d"]) > 0), number(m["d"]) / number(m["y"])).alias("q"), m["w"].alias("w")))
    plausible = F.array_sort(F.filter(found, lambda m: (m["q"] > LEAST_QUOTIENT) & (m["q"] < MOST_QUOTIENT)))
    middle = F.get(plausible, (F.size(plausible) / 2).cast("int"))
    median = F.when(F.size(plausible) > 0, F.struct(F.lit("CNY").alias("source"), F.lit("USD").alias("target"), F.round(middle["q"], 8).alias("rate"), F.substring(middle["w"], 1, 120).alias("raw"), F.size(plausible).alias("samples")))
    best, date = F.coalesce(*stated, median), F.coalesce(*[_first(text, p) for p in DATES])
    return F.when(best.isNotNull(), F.struct(best["source"].alias("source"), best["target"].alias("target"), best["rate"].alias("rate"), best["raw"].alias("raw"), best["samples"].alias("samples"), F.trim(date).alias("date")))


NO_NUMBER = ("NO", "NUMBER", "NUMBER:")
NO_NAME = ("SAME AS CONSIGNEE", "SAME AS SHIPPER")
NAME_BLOCK = r"(?s)Consignee[:\s]*(?:SAME\s+AS\s+CONSIGNEE)?(?:\s*Notify[:\s]*[^\n]*)?\n(.+?)(?:\nNo and Type|\nLine Number|\nCustoms|\nWayBill|\nMan Reg)"
INLINE = r"(?i)Consignee[:\s]+([A-Z][A-Z\s]+?)\s*\(\s*FREIGHT\s+([\d.]+)"
NO_LINE = r"(?i)^(Notify\b.*|SAME\s+AS\s+CONSIGNEE.*|any|e,?)$"


def _own_name(text: Column) -> Column:
    alone = F.trim(_first(text, r"Consignee[:\s]+([A-Z][A-Z\s]{3,}?)(?:\n|$)"))
    alone = F.when(~F.upper(alone).isin(*NO_NAME) & ~F.startswith(F.upper(alone), F.lit("NOTIFY")), alone)
    return F.coalesce(F.trim(_first(text, INLINE)), alone)


def _block(text: Column) -> Column:
    lines = F.transform(F.split(F.trim(_first(text, NAME_BLOCK)), "\n"), lambda line: F.rtrim(F.trim(line), F.lit(",")))
    return F.filter(lines, lambda line: (F.trim(line) != "") & ~F.rlike(line, F.lit(NO_LINE)))


def manifests(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``manifest`` of their texts as ``m``. A text, and what several fields are made from, is computed once. Patterns
    are costlier than reading: where a small table is read by few tasks, its rows should be dealt to more before."""
    own = docs.withColumns({"__own": _own_name(F.col(text)), "__lines": _block(F.col(text)), "__bill": _bill(F.col(text)), "__weight": _weight(F.col(text))})
    return own.select(*docs.columns, _fields(F.col(text), F.col("__own"), F.col("__lines"), F.col("__bill"), F.col("__weight")).alias("m"))


def _bill(text: Column) -> Column:
    return F.coalesce(_first(text, r"(?i)Bill\s+of\s+Lading\s+Number[:\s]*\n\s*\n?\s*([A-Z0-9]+)"), _first(text, r"(?i)Bill\s+of\s+Lading\s+Number[:\s]+([A-Z0-9]+)"))


def _weight(text: Column) -> Column:
    return F.replace(_first(text, r"Gross(?:\s+Mass)?[:\s]+([\d,.]+)"), F.lit(","), F.lit(""))


def manifest(text: Column) -> Column:
    """waybill, man_reg, consignee_name, consignee_address, packages, package_type, weight, freight, office, voyage and vessel of a customs manifest; null
    for other documents. A bill of lading's number goes before the waybill's; a freight next to the consignee before that of the goods."""
    return _fields(text, _own_name(text), _block(text), _bill(text), _weight(text))


def _fields(text: Column, own_name: Column, lines: Column, bill: Column, weight: Column) -> Column:
    way = F.trim(_first(text, r"WayBill(?:\s*Number)?[:\s]+(\S+)"))
    block_name = F.nullif(F.trim(F.regexp_replace(F.get(lines, F.lit(0)), r"\s*\(FREIGHT.*?\)", "")), F.lit(""))
    kinds = (r"(?i)No\s+and\s+Type\s+of\s+(\d+)\s+(\w+)", r"(?i)No\s+and\s+Type\s+of\s+[^0-9\n]*(\d+)\s*\n?\s*(\w+)")
    return F.when(
        F.contains(F.upper(text), F.lit("ASYCUDA")),
        F.struct(
            F.coalesce(F.upper(bill), F.when(~F.upper(way).isin(*NO_NUMBER), way)).alias("waybill"),
            F.trim(_first(text, r"Man\s*Reg\s*Number[:\s]*([\d]{4}[\s/]+\d+)")).alias("man_reg"),
            F.coalesce(own_name, block_name).alias("consignee_name"),
            F.when(own_name.isNull() & (F.size(lines) > 1), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), ", ")).alias("consignee_address"),
            F.coalesce(*[_first(text, p) for p in kinds]).alias("packages"),
            F.when(_first(text, kinds[0]).isNotNull(), _first(text, kinds[0], 2)).otherwise(_first(text, kinds[1], 2)).alias("package_type"),
            F.when(weight.try_cast("double") > 0, weight).alias("weight"),
            F.coalesce(_first(text, INLINE, 2), F.replace(_first(text, r"(?<!\()Freight\s+([\d,.]+)"), F.lit(","), F.lit(""))).alias("freight"),
            F.trim(_first(text, r"(?i)Customs\s*Office[:\s]+([A-Z\s]+?)(?:\s*Man\s*Reg|\n)")).alias("office"),
            _first(text, r"Voyage\s+(\S+)").alias("voyage"),
            F.trim(_first(text, r"Vessel\s*Name[:\s]+(.+?)(?:\n|$)")).alias("vessel"),
        ),
    )

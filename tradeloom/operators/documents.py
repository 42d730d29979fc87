"""Detection and parsing of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.operators.common import dimension, winners


def format_detected(docs: DataFrame, specs: DataFrame, text: str = "text", fold_case: bool = True) -> DataFrame:
    """``docs`` with ``format``: the first spec by priority (highest) and name none of whose ``none_of``, all of whose ``all_of`` and, if it
    has some, one of whose ``any_of`` are in the text; null if none. A spec without markers never fits.

    Each text meets all specs in one row (an array of those that fit), so texts aren't copied for each spec. specs: name,
    priority, all_of, any_of, none_of; a dimension of checked size.
    """
    cased = F.lower(F.col(text)) if fold_case else F.col(text)
    low = (lambda c: F.lower(c)) if fold_case else (lambda c: c)
    listed = dimension(specs.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("order"), "name", "all_of", "any_of", "none_of"))).alias("__specs")))
    fits = lambda s: (
        ~F.exists(s["none_of"], lambda p: F.contains(F.col("__text"), low(p)))
        & F.forall(s["all_of"], lambda p: F.contains(F.col("__text"), low(p)))
        & ((F.size(s["any_of"]) == 0) | F.exists(s["any_of"], lambda p: F.contains(F.col("__text"), low(p))))
        & ((F.size(s["all_of"]) > 0) | (F.size(s["any_of"]) > 0))
    )
    out = docs.withColumn("__text", cased).crossJoin(listed)
    return out.select(*docs.columns, F.get(F.filter("__specs", fits), 0)["name"].alias("format"))


def type_scored(text: Column, types: dict[str, tuple[list[str], dict[str, float]]], least: float = 0.15) -> Column:
    """The document type with the best score: the share of its keywords in the text, and boosts for markers; ``unknown`` below
    ``least``; the first of equals."""
    low = F.lower(text)
    scores = []
    for i, (name, (keywords, boosts)) in enumerate(types.items()):
        hits = sum((F.contains(low, F.lit(k)).cast("int") for k in keywords), F.lit(0)) / F.lit(float(len(keywords)))
        extra = sum((F.when(F.contains(low, F.lit(k)), F.lit(b)).otherwise(F.lit(0.0)) for k, b in boosts.items()), F.lit(0.0))
        scores.append(F.struct((hits + extra).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] >= least, best["name"]).otherwise("unknown")


def lines_of(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(ident, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def items_in_lines(lines: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Items of lines ``quantity description price``: the last amount of a line is its price, a leading number its quantity (1 if there
    is none); lines without both words and an amount are none."""
    price = F.element_at(F.regexp_extract_all("line", F.lit(r"(\d[\d,]*\.\d{2})\b"), F.lit(1)), -1)
    quantity = F.coalesce(F.nullif(F.regexp_extract("line", r"^\s*(\d{1,4})\s+[A-Za-z]", 1), F.lit("")).cast("int"), F.lit(1))
    body = F.trim(F.regexp_replace(F.regexp_replace("line", r"^\s*\d{1,4}\s+(?=[A-Za-z])", ""), r"\d[\d,]*\.\d{2}\b.*$", ""))
    found = lines.withColumn("__price", F.when(F.regexp_count("line", F.lit(r"\d[\d,]*\.\d{2}\b")) > 0, price))
    return found.filter(F.col("__price").isNotNull()).select(ident, "line_no", quantity.alias("quantity"), body.alias("description"), F.replace("__price", F.lit(","), F.lit("")).cast("decimal(18,2)").alias("amount"))


def markup_text(html: Column) -> Column:
    """The visible text of a page: scripts, styles, comments and tags dropped, common entities resolved, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def section(text: Column, start: str, ends: list[str]) -> Column:
    """From the first start marker to the earliest end marker after it, or to the end; empty without a start."""
    at = F.instr(text, start)
    rest = F.substr(text, at + len(start))
    stops = [F.when(F.instr(rest, e) > 0, F.instr(rest, e)) for e in ends]
    stop = F.least(*stops) if len(stops) > 1 else stops[0]
    return F.when(at == 0, F.lit("")).otherwise(F.substr(rest, F.lit(1), F.coalesce(stop - 1, F.length(rest))))


def recovered_price(lines: DataFrame, gaps: DataFrame, within: float = 0.25, least: float = 0.02) -> DataFrame:
    """doc_id and the uncaptured price nearest to what is missing: only where more than ``least`` is missing, and within ``within``."""
    prices = lines.select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(r"(\d+\.\d{2})\b"), F.lit(1))).alias("p")).select("doc_id", F.col("p").cast("decimal(18,2)").alias("price"))
    near = prices.join(gaps.filter(F.col("gap") > least), "doc_id").withColumn("off", F.abs(F.col("price") - F.col("gap"))).filter(F.col("off") <= within)
    return winners(near, ["doc_id"], F.col("off"), F.col("price")).select("doc_id", "price", "off")


def price_tokens(lines: DataFrame) -> DataFrame:
    """token and where it is: documents and lines that have the same price, counted."""
    each = lines.select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"(\d+\.\d{2})\b"), F.lit(1))).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc"))

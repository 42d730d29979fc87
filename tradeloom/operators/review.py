"""Small checks and lookups around items, rules, bills and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.operators.classification import corrected
from tradeloom.operators.common import bounded, contained_in, winners
from tradeloom.operators.lookup import cached

#: Labels of a totals section (fixed values).
FOOTER_LABELS = (
    r"grand\s*tot(?:al|ak)", r"sub.?total", r"estimated\s*tax", r"order\s*total", r"total\s*before\s*tax", r"item\s*\(\s*s\s*\)\s*subtotal", r"payment\s*method", r"shipping\s*(?:&|and)\s*handling",
)
#: Label of a bill's line and the charge that it is, the first that a line has (fixed values).
BILL_CHARGES = {
    "OCEAN FREIGHT": "ocean_freight", "TERMINAL HANDLING": "terminal_handling", "LANDING": "landing", "BILL OF LADING PROCESSING": "bl_processing", "BILL OF LADING": "bl_processing",
    "ELECTRONIC EXPORT INFORMATION": "eei", "BUNKER SURCHARGE": "bunker_surcharge", "HAZARDOUS CARGO SURCHARGE": "hazardous_cargo", "OPERATIONAL SERVICE": "operational_service",
    "PEAK SEASON SURCHARGE": "peak_season", "PALLET SURCHARGE": "pallet_surcharge", "SECURITY SURCHARGE": "security_surcharge", "INSURANCE PREMIUM": "insurance_premium",
    "SP HANDLING FEE": "sp_handling_fee", "TOTAL USD": "total_usd", "USD": "total_usd",
}
#: Sources of a code that a chapter check doesn't question (fixed values).
TRUSTED_SOURCES = ("rule", "classification_rule", "manual_correction")
#: Column of a table and the words that its header may have, looked for in this order (fixed values).
HEADERS = {
    "description": ("description", "item", "product", "name"),
    "quantity": ("qty", "quantity", "units"),
    "unit_cost": ("unit cost", "unit price", "price", "rate"),
    "total_cost": ("total", "amount", "ext", "extended"),
    "sku": ("sku", "item #", "item no", "code", "part"),
}
MONEY = "decimal(18,2)"


def rules_found(rules: DataFrame, text: str, field: str = "all") -> DataFrame:
    """``rules`` (code, category, patterns) whose code has ``text`` in capitals, or whose category or a pattern has it in any case; ``field``: one of the three
    only."""
    asked = F.lit(text.upper())
    tests = {
        "code": F.contains("code", asked),
        "category": F.contains(F.upper("category"), asked),
        "patterns": F.exists("patterns", lambda p: F.contains(F.upper(p), asked)),
    }
    chosen = [F.coalesce(t, F.lit(False)) for k, t in tests.items() if field in ("all", k)]
    out = chosen[0]
    for t in chosen[1:]:
        out = out | t
    return rules.filter(out)


def rules_queried(rules: DataFrame, queries: DataFrame) -> DataFrame:
    """word, field, id and code: for every query (word, field) the rules (id, code, category, patterns) that ``rules_found`` finds for it. Each different
    text of a rule is looked at once, and rules of the same texts are found as one: so what is found is made distinct before it is given to the rules."""
    upper = lambda c: F.upper(F.coalesce(c, F.lit("")))
    named = F.array(F.struct(F.lit("code").alias("own"), F.coalesce("code", F.lit("")).alias("text")), F.struct(F.lit("category").alias("own"), upper(F.col("category")).alias("text")))
    every = F.concat(named, F.transform(F.coalesce("patterns", F.array().cast("array<string>")), lambda p: F.struct(F.lit("patterns").alias("own"), upper(p).alias("text"))))
    own = rules.select("id", "code", every.alias("texts")).groupBy("id", "code").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("texts")))).alias("texts"))
    alike = own.select("texts").distinct()
    each = alike.select("texts", F.explode("texts").alias("t")).select("texts", "t.*")
    asked = queries.select("word", "field", F.upper("word").alias("__word")).distinct()
    met = contained_in(asked.select("__word").distinct(), each.select("text").distinct(), "__word", "text")
    found = asked.join(met, "__word").join(each, "text").filter((F.col("field") == "all") | (F.col("field") == F.col("own")))
    return own.join(found.select("texts", "word", "field").distinct(), "texts").select("word", "field", "id", "code")


def unknown_items(items: DataFrame) -> DataFrame:
    """``items`` without a code, with code UNKNOWN or marked for review, once for each description, with how many there are."""
    left = items.filter(F.col("code").isNull() | F.col("code").isin("", "UNKNOWN") | F.coalesce("needs_review", F.lit(False)))
    return left.groupBy("description").agg(F.count("*").alias("n"), F.min("item_id").alias("first_item"))


def disabled(codes: DataFrame, orders: DataFrame) -> DataFrame:
    """``codes`` (code, enabled, notes) after ``orders`` (code, reason): disabled, with the reason appended to the notes."""
    asked = orders.groupBy("code").agg(F.max("reason").alias("__reason"), F.lit(True).alias("__off"))
    note = F.concat(F.lit("Disabled: "), F.coalesce("__reason", F.lit("No reason provided")))
    out = codes.join(asked, "code", "left")
    off = F.coalesce("__off", F.lit(False))
    notes = F.when(off, F.concat_ws(" | ", "notes", note)).otherwise(F.col("notes"))
    return out.select(*[{"enabled": F.col("enabled") & ~off, "notes": notes}.get(c, F.col(c)).alias(c) for c in codes.columns])


def new_only(found: DataFrame, known: DataFrame, ident: str = "id") -> DataFrame:
    """Rows whose ``ident`` isn't known yet, each once: the first by all its columns."""
    return winners(found.join(known.select(ident).distinct(), ident, "left_anti"), [ident], *[F.col(c) for c in found.columns])


def document_types(names: DataFrame, rules: DataFrame, name: str, default: str) -> DataFrame:
    """``names`` with the doc_type of the first rule (seq, words, doc_type) of which the name has a word, in any case; else the default."""
    has = F.exists("words", lambda w: (w != "") & F.contains(F.lower(F.trim(name)), F.lower(w)))
    hits = names.select(name).filter(F.col(name).isNotNull()).distinct().crossJoin(bounded(rules)).filter(has)
    return names.join(winners(hits, [name], F.col("seq")).select(name, "doc_type"), name, "left").fillna(default, ["doc_type"])


def matches_in_full(text: Column, patterns: list[str]) -> Column:
    """Whether one of the expressions matches the whole text; no text matches none."""
    return F.coalesce(F.rlike(text, F.lit("^(?:" + "|".join(f"(?:{p})" for p in patterns) + r")\z")), F.lit(False)) if patterns else F.lit(False)


def bogus(items: DataFrame, group: str) -> DataFrame:
    """``group`` and reason where half of the items or more are labels of a totals section, or have no quantity but a price."""
    label = F.lower("description").rlike(r"\b(" + "|".join(FOOTER_LABELS) + r")\b")
    price = F.col("unit_cost") if "unit_cost" in items.columns else F.lit(0)
    priced = (F.coalesce("quantity", F.lit(0)) == 0) & ((F.coalesce("total_cost", F.lit(0)) > 0) | (F.coalesce(price, F.lit(0)) > 0))
    sums = items.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.coalesce(label, F.lit(False)).cast("int")).alias("labels"), F.sum(priced.cast("int")).alias("priced"))
    reason = F.when(F.col("labels") * 2 >= F.col("n"), "labels").when(F.col("priced") * 2 >= F.col("n"), "no quantity")
    return sums.select(group, "n", reason.alias("reason")).filter("reason IS NOT NULL")


def reversed_scans(pages: DataFrame, group: str, order: str, position: str) -> DataFrame:
    """``group`` and pages of documents scanned from the last page to the first: three pages or more, one header, on the last, and one footer, on
    the first."""
    at = lambda kind, best: best(F.when(F.col(position) == kind, F.col(order)))
    n = lambda kind: F.sum((F.col(position) == kind).cast("int"))
    sums = pages.groupBy(group).agg(
        F.count("*").alias("pages"), n("header").alias("heads"), n("footer").alias("feet"), at("header", F.min).alias("head"), at("footer", F.min).alias("foot"), F.min(order).alias("first"), F.max(order).alias("last")
    )
    return sums.filter("pages >= 3 AND heads = 1 AND feet = 1 AND head = last AND foot = first").select(group, "pages")


def without_orders(items: DataFrame) -> DataFrame:
    """Items in the columns of matched ones: the SKU or a made-up number, and the unit price derived from the total where it is missing."""
    q, total = F.coalesce("quantity", F.lit(0)), F.coalesce("total_cost", F.lit(0))
    unit = F.coalesce("unit_cost", F.lit(0))
    price = F.when((unit == 0) & (total != 0) & (q != 0), F.round((total / q).cast("decimal(28,8)"), 2)).otherwise(unit)
    empty = [F.lit("").alias(c) for c in ("po_item_ref", "po_item_desc", "po_number", "uom")]
    made = F.coalesce(F.nullif("sku", F.lit("")), F.concat(F.lit("ITEM-"), F.when(F.col("seq") < 1000, F.lpad(F.col("seq").cast("string"), 3, "0")).otherwise(F.col("seq").cast("string"))))
    return items.select("invoice_id", "seq", *empty, made.alias("supplier_item"), "description", q.alias("quantity"), price.cast(MONEY).alias("unit_price"), total.alias("total_cost"), F.lit(0).alias("match_score"))


def provenance(items: DataFrame) -> DataFrame:
    """invoice_id and meta: the items' sources as JSON, in order."""
    each = F.struct("seq", "sku", "tariff_code", F.col("source"))
    return items.groupBy("invoice_id").agg(F.to_json(F.array_sort(F.collect_list(each))).alias("meta"))


def file_hashes(files: DataFrame) -> DataFrame:
    """path and sha256 of files as Spark's ``binaryFile`` source gives them."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def correction_term(formula: Column) -> Column:
    """The number after the closing bracket of ``=(...)+n``; 0 where there is none."""
    return F.coalesce(F.replace(F.regexp_extract(formula, r"^=\([^)]+\)\s*([+-].+)$", 1), F.lit("+-"), F.lit("-")).try_cast("double"), F.lit(0.0))


def forced(formula: Column, rest: Column) -> Column:
    """The adjustment's formula with ``rest`` as its only correction, so that the variance becomes nothing; repeated use replaces it. A plain number
    takes the rest up."""
    base = F.regexp_extract(formula, r"^(=\([^)]*\))", 1)
    plain = (F.coalesce(formula.try_cast(MONEY), F.lit(0).cast(MONEY)) + rest).cast(MONEY).cast("string")
    return F.when(base != "", F.concat(base, F.lit("+"), rest.cast("string"))).otherwise(plain)


def resolved(template: Column, context: Column) -> Column:
    """A template's text: ``${name}`` alone gives the context's value or null; after other text the value, or nothing, is appended; else the template."""
    at = F.instr(template, F.lit("${"))
    key = F.regexp_replace(F.substr(template, at + 2), r"\}$", "")
    value = F.element_at(context, key)
    return F.when(at == 1, value).when(at > 1, F.concat(F.substr(template, F.lit(1), at - 1), F.coalesce(value, F.lit("")))).otherwise(template)


def bill_charges(lines: DataFrame, group: str, order: str) -> DataFrame:
    """``group``, charge and amount of a bill's lines: a label and an amount, ``USD amount ...``, or ``USD`` with the amount on the next line. Of
    several lines of one charge the last counts."""
    text = F.trim("line")
    money = lambda c, p: F.replace(F.regexp_extract(c, p, 1), F.lit(","), F.lit("")).try_cast(MONEY)
    label = F.upper(F.trim(F.regexp_extract(text, r"^(.+?)\s+[\d,]+\.\d{2}\s*$", 1)))
    labelled = F.coalesce(*[F.when(F.contains(label, F.lit(k)), F.lit(v)) for k, v in BILL_CHARGES.items()])
    following = F.trim(F.lead("line").over(Window.partitionBy(group).orderBy(order)))
    is_line = text.rlike(r"^.+?\s+[\d,]+\.\d{2}\s*$")
    usd = r"(?i)^(?:TOTAL\s+)?USD\s+([\d,]+\.\d{2})"
    split = F.upper(text).isin("USD", "TOTAL USD") & following.rlike(r"^[\d,]+\.\d{2}")
    charge = F.when(is_line, labelled).when(text.rlike(usd) | split, F.lit("total_usd"))
    amount = F.when(is_line, money(text, r"([\d,]+\.\d{2})\s*$")).when(text.rlike(usd), money(text, usd)).when(split, money(following, r"^([\d,]+\.\d{2})"))
    found = lines.withColumn("charge", charge).withColumn("amount", amount).filter("charge IS NOT NULL")
    return winners(found, [group, "charge"], F.col(order).desc()).select(group, "charge", "amount")


def inconsistent(items: DataFrame) -> DataFrame:
    """``items`` whose code has another chapter than the expected one; those of trusted sources, without an expectation or a code aren't questioned."""
    asked = (F.coalesce("expected_chapter", F.lit("")) != "") & (F.coalesce("code", F.lit("00000000")) != "00000000") & ~F.coalesce("source", F.lit("")).isin(*TRUSTED_SOURCES)
    return items.filter(asked & (F.substring("code", 1, 2) != F.col("expected_chapter")))


def reclassified(items: DataFrame, cache: DataFrame, valid: DataFrame, invalid: DataFrame) -> DataFrame:
    """``items`` (item_id, term, code, expected_chapter, source) with new_code and outcome. An item whose chapter isn't the expected one (``inconsistent``)
    is looked up in the cache by its term: first in all of it, then among codes of the expected chapter only. An answer counts if it has that
    chapter, before and after it is corrected; outcome is then ``cache`` or ``second``, else ``kept``. Other items are ``consistent``."""
    asked = inconsistent(items).select("item_id", "term", "expected_chapter")
    usable = cache.filter("code IS NOT NULL AND code <> 'UNKNOWN'").select("key", "code")
    found = cached(asked.select("term").filter("term <> ''").distinct(), usable).select("term", F.col("code").alias("__code"))
    first = asked.join(found, "term").filter(F.substring("__code", 1, 2) == F.col("expected_chapter"))
    chapters = asked.join(first.select("item_id"), "item_id", "left_anti")
    # a term and its chapter are one key, so that only codes of the chapter meet
    wanted = chapters.filter("term <> ''").select("expected_chapter", F.col("term")).distinct()
    tagged = usable.withColumn("chapter", F.substring("code", 1, 2))
    pairs = contained_in(tagged, wanted, "key", "term").union(contained_in(wanted, tagged, "term", "key").select("key", "code", "chapter", "expected_chapter", "term"))
    best = winners(pairs.filter("chapter = expected_chapter"), ["term", "expected_chapter"], (F.col("key") != F.col("term")), F.col("key"), F.col("code")).select("term", "expected_chapter", F.col("code").alias("__code"))
    second = chapters.join(best, ["term", "expected_chapter"])
    answers = first.select("item_id", "expected_chapter", "__code", F.lit("cache").alias("__how")).unionByName(second.select("item_id", "expected_chapter", "__code", F.lit("second").alias("__how")))
    kept = corrected(answers, valid, invalid, "__code").filter(F.substring("corrected", 1, 2) == F.col("expected_chapter")).select("item_id", F.col("corrected").alias("__new"), "__how")
    out = items.join(kept, "item_id", "left").join(asked.select("item_id", F.lit(True).alias("__asked")), "item_id", "left")
    return out.select(*items.columns, F.coalesce("__new", "code").alias("new_code"), F.coalesce("__how", F.when(F.col("__asked"), "kept"), F.lit("consistent")).alias("outcome"))


def primary_bill(files: DataFrame, group: str, words: list[str]) -> DataFrame:
    """``group``, name and score of the file that reads most like a bill of lading: a point for each expression found, two for its name; the first of
    equals, and the first file where none has text."""
    text, name = F.upper("text"), F.lower("name")
    points = sum((F.coalesce(text.rlike(w), F.lit(False)).cast("int") for w in words), F.lit(0))
    named = F.when(F.contains(name, F.lit("bill_of_lading")) | name.startswith("bl"), 2).otherwise(0)
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    scored = files.withColumn("score", F.when(blank, -1).otherwise(points + named))
    return winners(scored, [group], F.col("score").desc(), F.col("name")).select(group, "name", "score")


def order_file(rows: DataFrame, invoices: DataFrame) -> DataFrame:
    """shipment_id, file and hits: the order workbook of which most rows name one of the shipment's invoices; the first of equals. A row names it in
    brackets in its order reference, with or without hyphens; without brackets, by a number in its first cell (``number``, if there is such a
    column; slashes as in file names) that is part of the invoice's. rows: file, order_ref, number; invoices: shipment_id, ref."""
    rows = rows if "number" in rows.columns else rows.withColumn("number", F.lit(None).cast("string"))
    listed = F.split(F.lower(F.regexp_extract("order_ref", r"\(([^)]+)\)", 1)), "/")
    bracketed = F.coalesce(F.col("order_ref").rlike(r"\([^)]+\)"), F.lit(False))
    refs = F.array_sort(F.array_distinct(F.filter(F.transform(listed, lambda r: F.replace(F.trim(r), F.lit("-"), F.lit(""))), lambda r: r != "")))
    # rows of a file that name the same are counted before they meet shipments
    named = rows.filter(bracketed).groupBy("file", refs.alias("refs")).agg(F.count("*").alias("n"))
    ours = invoices.select("shipment_id", F.replace(F.lower("ref"), F.lit("-"), F.lit("")).alias("ref")).distinct()
    known = named.select("file", "refs", "n", F.explode("refs").alias("ref")).join(ours.select("ref").distinct(), "ref", "left_semi").groupBy("file", "refs", "n").agg(F.array_sort(F.collect_list("ref")).alias("known"))
    known = known.groupBy("file", "known").agg(F.sum("n").alias("n"))
    by_ref = known.withColumn("ref", F.explode("known")).join(ours, "ref").select("shipment_id", "file", "known", "n").distinct().select("shipment_id", "file", "n")
    number = F.lower(F.replace("number", F.lit("/"), F.lit("_")))
    cells = rows.filter(~bracketed).groupBy("file", number.alias("__number")).agg(F.count("*").alias("n"))
    stems = invoices.select("shipment_id", F.explode(F.array(F.lower("ref"), F.replace(F.lower("ref"), F.lit("-"), F.lit("")))).alias("__stem")).distinct()
    met = contained_in(cells.select("__number").distinct(), stems.select("__stem").distinct(), "__number", "__stem")
    wanted = stems.join(met, "__stem").select("shipment_id", "__number").distinct()
    by_cell = wanted.join(cells, "__number").select("shipment_id", "file", "n")
    hits = by_ref.unionByName(by_cell).groupBy("shipment_id", "file").agg(F.sum("n").alias("hits"))
    return winners(hits, ["shipment_id"], F.col("hits").desc(), F.col("file"))


def extracted(items: DataFrame, codes: DataFrame, goods: DataFrame, links: DataFrame, inventory: DataFrame) -> DataFrame:
    """Assessed items with code, both descriptions and the inventory number ('' where there is none); descriptions of over three characters and
    codes of six or more."""
    out = items.filter("is_assessed").join(codes, "item_id").join(goods, "item_id").join(links, "item_id", "left").join(inventory, "inventory_id", "left")
    kept = out.filter((F.length(F.trim("commercial")) > 3) & (F.length("code") >= 6))
    return kept.select("item_id", "code", "commercial", "goods", F.coalesce("item_number", F.lit("")).alias("item_number"))


def dumped_codes(lines: DataFrame) -> DataFrame:
    """``lines`` (line) of a database's plain dump as code, commercial, goods and item_number: a code of six to eight digits, padded with zeros; a last
    token that looks like an inventory number; a tail of capitals, of ten characters or more, that is the heading's text."""
    bare = F.replace(F.regexp_extract("line", r"^\s*(\S+)", 1), F.lit("."), F.lit(""))
    code = F.when(F.length(bare) == 8, bare).when(F.length(bare).isin(6, 7), F.rpad(bare, 8, "0"))
    rest = F.trim(F.regexp_extract("line", r"^\s*\S+\s*(.*)$", 1))
    last = F.regexp_extract(rest, r"\s(\S+)$", 1)
    is_number = F.contains(last, F.lit("/")) | ((F.length(last) <= 20) & last.rlike(r"^[A-Z0-9][A-Z0-9.-]+$"))
    item = F.when(is_number, last).otherwise("")
    block = F.when(is_number, F.trim(F.regexp_replace(rest, r"\s\S+$", ""))).otherwise(rest)
    tail = F.regexp_extract(block, r"\s([A-Z][A-Z\s,()/-]+)\s*$", 1)
    goods = F.when(F.length(tail) >= 10, F.trim(tail)).otherwise("")
    commercial = F.when(goods != "", F.trim(F.substr(block, F.lit(1), F.length(block) - F.length(tail)))).otherwise(block)
    kept = lines.filter(~F.col("line").rlike(r"^[(-]") & bare.rlike("^[0-9]+$"))
    return kept.select("line", code.alias("code"), commercial.alias("commercial"), goods.alias("goods"), item.alias("item_number")).filter("code IS NOT NULL AND length(commercial) >= 3")


def column_places(header: Column) -> Column:
    """A map of columns to places (from 0) of an array of header cells: the first cell that has one of the column's words."""
    cells = F.transform(header, lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    place = lambda words: F.array_min(F.filter(F.transform(cells, lambda c, i: F.when(_has_any(c, words), i)), lambda i: i.isNotNull()))
    entries = F.array(*[F.struct(F.lit(k).alias("key"), place(w).alias("value")) for k, w in HEADERS.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def dump_items(lines: DataFrame, group: str, order: str) -> DataFrame:
    """Items of tab-separated dumps, whose first line names the columns: sku, description, quantity, unit_cost and total_cost of the lines with a
    description; numbers that can't be read are 0."""
    first = winners(lines, [group], F.col(order)).select(group, F.col(order).alias("__first"), F.transform(F.split("line", "\t"), lambda c: F.lower(F.trim(c))).alias("__h"))
    last_place = lambda test: F.array_max(F.filter(F.transform(F.col("__h"), lambda c, i: F.when(test(c), i)), lambda i: i.isNotNull()))
    has = lambda c, w: F.contains(c, F.lit(w))
    number = lambda c: has(c, "invoiceno") | (has(c, "invoice") & has(c, "number"))
    code = lambda c: ~number(c) & (has(c, "itemnumber") | (has(c, "item") & has(c, "number") & ~has(c, "desc")))
    text = lambda c: ~number(c) & ~code(c) & has(c, "description")
    amount = lambda c: ~number(c) & ~code(c) & ~text(c) & has(c, "quantity")
    cost = lambda c: ~number(c) & ~code(c) & ~text(c) & ~amount(c) & has(c, "cost")
    places = first.select(group, "__first", *[last_place(t).alias(f"__{k}") for k, t in (("sku", code), ("description", text), ("quantity", amount), ("unit_cost", cost))])
    cells = lines.withColumn("__c", F.split("line", "\t")).join(places, group).filter(F.col(order) > F.col("__first"))
    cell = lambda k: F.trim(F.get("__c", F.col(f"__{k}")))
    value = lambda k: F.coalesce(F.replace(cell(k), F.lit(","), F.lit("")).try_cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)"))
    out = cells.select(group, order, cell("sku").alias("sku"), cell("description").alias("description"), value("quantity").alias("quantity"), value("unit_cost").alias("unit_cost"))
    return out.filter("description <> ''").withColumn("total_cost", (F.col("quantity") * F.col("unit_cost")).cast("decimal(28,8)"))


def delimited_items(lines: DataFrame, places: dict[str, int], delimiter: str = "\t", skip: list[str] | None = None) -> DataFrame:
    """``lines`` (line) as items: description, quantity, unit_price and total_cost by their ``places``; the total is computed where it is empty. Short lines, lines
    with a ``skip`` expression and those whose numbers can't be read are no items."""
    text = F.trim("line")
    cells = F.split(text, "\\Q" + delimiter + "\\E")
    kept = lines.filter(text != "")
    for p in skip or []:
        kept = kept.filter(~text.rlike(p))
    cell = lambda k, other: F.trim(F.get(cells, F.lit(places[k]))) if k in places else F.lit(other)
    money = lambda c: F.regexp_replace(c, r"[$,\s]", "").try_cast("decimal(18,4)")
    quantity, unit = cell("quantity", "1").try_cast("decimal(18,4)"), money(cell("unit_price", "0"))
    total = F.when(cell("total_cost", "") == "", (quantity * unit).cast("decimal(18,4)")).otherwise(money(cell("total_cost", "")))
    read = kept.filter(F.size(cells) > max(places.values(), default=0))
    out = read.select(*lines.columns, cell("description", "").alias("description"), quantity.alias("quantity"), unit.alias("unit_price"), total.alias("total_cost"))
    return out.dropna(subset=["quantity", "unit_price", "total_cost"])


def positional_items(lines: DataFrame, group: str, order: str, shortest: int = 10, apart: int = 2) -> DataFrame:
    """Items where descriptions and prices were read apart: the i-th line of text with the i-th line of a price, or of a quantity and a price. Documents whose
    counts differ by more than ``apart`` give none; the longer list is cut."""
    text = F.trim("line")
    with_quantity, alone = text.rlike(r"^\d+\s+[\d,]+\.\d{2}\s*$"), text.rlike(r"^\$?[\d,]+\.\d{2}\s*$")
    kind = F.when(with_quantity | alone, "price").when((F.length(text) >= shortest) & ~text.rlike(r"^[\d$.,\s]+$"), "text")
    marked = lines.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("at", F.row_number().over(Window.partitionBy(group, "kind").orderBy(order)))
    price = F.replace(F.regexp_extract(text, r"([\d,]+\.\d{2})\s*$", 1), F.lit(","), F.lit("")).try_cast(MONEY)
    quantity = F.when(with_quantity, F.regexp_extract(text, r"^(\d+)", 1).try_cast("int")).otherwise(1)
    sides = marked.groupBy(group, "at").agg(
        F.max(F.when(F.col("kind") == "text", text)).alias("description"), F.max(F.when(F.col("kind") == "price", quantity)).alias("quantity"), F.max(F.when(F.col("kind") == "price", price)).alias("unit_cost")
    )
    counts = marked.groupBy(group).agg(F.sum((F.col("kind") == "text").cast("int")).alias("texts"), F.sum((F.col("kind") == "price").cast("int")).alias("prices"))
    fit = counts.filter((F.abs(F.col("texts") - F.col("prices")) <= apart) & (F.col("texts") > 0) & (F.col("prices") > 0)).select(group)
    out = sides.dropna(subset=["description", "unit_cost"]).join(fit, group, "left_semi")
    return out.withColumn("total_cost", (F.col("quantity") * F.col("unit_cost")).cast(MONEY))


def accuracy_of(found: DataFrame, truth: DataFrame, ident: str = "item_id") -> DataFrame:
    """mode, n, covered and right of each ``mode`` of ``found`` (mode, item, code or null) against ``truth`` (item, code)."""
    joined = found.join(truth.withColumnRenamed("code", "__true"), ident)
    known = F.col("code").isNotNull() & (F.col("code") != "UNKNOWN")
    return joined.groupBy("mode").agg(F.count("*").alias("n"), F.sum(known.cast("int")).alias("covered"), F.sum((known & (F.col("code") == F.col("__true"))).cast("int")).alias("right"))

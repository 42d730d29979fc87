"""Documents parsed as the specs of their formats say.

A spec is a dict (or its JSON): ``name``, ``priority``, ``source`` (main or auto), ``detect`` (all_of, any_of, none_of), ``clean`` (pattern, replace),
``section`` (start, ends), ``metadata`` (field to patterns and type) and ``items``. All specs are compiled into one plan: a document's columns are
those of its format's branch, so a new spec is a new branch and no new job.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.operators.documents import format_detected, section
from tradeloom.operators.lookup import field
from tradeloom.operators.parsing import typed

NUMERIC = ("currency", "number", "integer")
#: Fields that have columns of their own; others are attributes.
TEXTS, NUMBERS = ("sku", "description"), ("quantity", "unit_cost", "total_cost")
ITEM = "struct<sku: string, description: string, quantity: double, unit_cost: double, total_cost: double, attributes: map<string,string>>"
#: Specs in one plan; more should be split by detection first.
MOST_SPECS = 500


class SpecError(ValueError):
    """A spec that can't be compiled."""


def registered(specs: Iterable[dict | str]) -> list[dict]:
    """Specs in the order in which they are tried: by priority (automatic ones have less by default) and name. Of several with one name a main one
    stays, else the first."""
    read = [json.loads(s) if isinstance(s, str) else dict(s) for s in specs]
    found: dict[str, dict] = {}
    for s in sorted(read, key=lambda s: s.get("source", "main") != "main"):
        found.setdefault(s["name"], {"priority": -10 if s.get("source") == "auto" else 0, **s})
    if len(found) > MOST_SPECS:
        raise SpecError(f"over {MOST_SPECS} specs in one plan")
    return sorted(found.values(), key=lambda s: (-s["priority"], s["name"]))


def specs_of(table: DataFrame) -> list[dict]:
    """Specs out of a table with a JSON column ``spec``; as many as one plan holds."""
    return registered(r["spec"] for r in table.select("spec").limit(MOST_SPECS + 1).collect())


def arithmetic(expression: str, known: dict[str, Column]) -> Column:
    """A column of an expression of + - * / over numbers and ``known`` names; null where a value is missing or a division fails. Anything else is
    refused."""

    def walk(node: ast.AST) -> Column:
        match node:
            case ast.Expression(body=body):
                return walk(body)
            case ast.Constant(value=int() | float() as value) if not isinstance(value, bool):
                return F.lit(float(value))
            case ast.Name(id=name) if name in known:
                return known[name].cast("double")
            case ast.UnaryOp(op=ast.USub(), operand=inner):
                return -walk(inner)
            case ast.BinOp(left=left, op=ast.Add() | ast.Sub() | ast.Mult() | ast.Div() as op, right=right):
                a, b = walk(left), walk(right)
                return F.try_divide(a, b) if isinstance(op, ast.Div) else a + b if isinstance(op, ast.Add) else a - b if isinstance(op, ast.Sub) else a * b
        raise SpecError(f"not allowed in {expression!r}")

    try:
        return walk(ast.parse(expression, mode="eval"))
    except SyntaxError as e:
        raise SpecError(f"not an expression: {expression!r}") from e


def is_arithmetic(template: str) -> bool:
    return any(f" {op} " in template for op in "+-*/")


def filled(template: str, known: dict[str, Column]) -> Column:
    """A text with ``{name}`` (or ``{name:03d}``) replaced; the template itself where a value is missing or unknown."""
    parts: list[Column] = []
    for literal, name, _, digits in re.findall(r"([^{}]*)(?:\{(\w+)(:0(\d+)d)?\})?", template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            value = known[name].cast("string") if name in known else F.lit(None).cast("string")
            parts.append(F.lpad(value, int(digits), "0") if digits else value)
    return F.coalesce(F.concat(*parts), F.lit(template))


def _replacement(text: str) -> str:
    """A replacement that names groups by a backslash, as the engine has them."""
    return re.sub(r"\\(\d)", r"${\1}", text.replace("$", "\\$")).replace("${", "$").replace("}", "") if "\\" in text else text.replace("$", "\\$")


def _many(pattern: str) -> str:
    return pattern if pattern.startswith("(?") and "m" in pattern[2 : pattern.find(")")] else f"(?m){pattern}"


def cleaned(text: Column, rules: list) -> Column:
    for rule in rules:
        pattern, by = (rule["pattern"], rule.get("replace", "")) if isinstance(rule, dict) else rule
        text = F.regexp_replace(text, _many(pattern), _replacement(by))
    return text


def _read(raw: dict[str, Column], spec: dict) -> Column:
    """A struct of an item's fields, of their types, from text (null for none)."""
    kinds, fields = spec.get("types", {}), []
    for name, value in raw.items():
        kind = kinds.get(name, "string")
        value = typed(value, kind)
        if name in spec.get("clean_fields", {}) and kind not in NUMERIC:
            value = F.trim(cleaned(value, spec["clean_fields"][name]))
        fields.append(value.alias(name))
    return F.struct(*fields) if fields else F.struct(F.lit(None).cast("string").alias("__none"))


def _finished(read: Column, spec: dict, index: Column) -> Column:
    """An item's struct from its fields."""
    kinds = spec.get("types", {})
    fields = {name: read[name] for name in spec["field_map"]}
    for name, template in spec.get("generated_fields", {}).items():
        numbers = {n: c for n, c in fields.items() if kinds.get(n) in NUMERIC} | {"index": index}
        if not isinstance(template, str):
            made = F.lit(float(template)) if name in NUMBERS else F.lit(str(template))
        elif is_arithmetic(template):
            made = arithmetic(template, numbers)
        else:
            made = filled(template, fields | {"index": index})
        kinds = kinds if name in kinds or not isinstance(template, str) or not is_arithmetic(template) else kinds | {name: "number"}
        fields[name] = F.coalesce(fields[name], made) if name in fields else made
    number = lambda name: fields[name].cast("double") if name in fields else F.lit(None).cast("double")
    total = F.coalesce(number("total_cost"), number("line_total"))
    unit = number("unit_price")
    total = F.coalesce(total, F.round(unit * F.coalesce(number("quantity"), F.lit(1.0)), 2))
    sku = F.nullif(fields.get("sku", F.lit(None).cast("string")).cast("string"), F.lit(""))
    sku = F.coalesce(sku, fields["catalog_num"].cast("string")) if "catalog_num" in fields else sku
    rest = {n: c for n, c in fields.items() if n not in (*TEXTS, *NUMBERS, "unit_price", "line_total")}
    pairs = [x for n, c in rest.items() for x in (F.lit(n), c.cast("string"))]
    attributes = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    text = fields.get("description", F.lit(None)).cast("string")
    return F.struct(sku.alias("sku"), text.alias("description"), number("quantity").alias("quantity"), F.coalesce(number("unit_cost"), unit).alias("unit_cost"), total.alias("total_cost"), attributes.alias("attributes"))


def _kept(rows: Column, spec: dict, raw) -> Column:
    """Rows that will have a description or an article number."""
    if "sku" in spec.get("generated_fields", {}):
        return rows
    named = [n for n in ("description", "sku", "catalog_num") if n in spec["field_map"]]
    return F.filter(rows, lambda r: F.coalesce(*[F.nullif(F.trim(raw(r)[n]), F.lit("")) for n in named]).isNotNull())


def _items(rows: Column, spec: dict, raw) -> Column:
    # in two steps, as an expression inside a lambda is computed wherever it is named
    read = F.transform(_kept(rows, spec, raw), lambda r: _read(raw(r), spec))
    return F.transform(read, lambda r, i: _finished(r, spec, i + 1)).cast(f"array<{ITEM}>")


def _matches(text: Column, pattern: str, groups: Iterable[int]) -> Column:
    """All matches as an array of structs of groups: m is the whole. A text is searched once for each group."""
    columns = [F.regexp_extract_all(text, F.lit(_many(pattern)), F.lit(g)).alias("m" if g == 0 else f"g{g}") for g in (0, *sorted(set(groups)))]
    return F.arrays_zip(*columns)


def _line_items(text: Column, spec: dict) -> tuple[Column, Column]:
    """One item a match, and the total of matches that are skipped (cancelled items, say). Extra patterns look at what the first one leaves."""
    fields = spec["field_map"]
    raw = lambda r: {n: F.nullif(r[f"g{g}"], F.lit("")) for n, g in fields.items()}
    rows = _matches(text, spec["pattern"], fields.values())
    skip = [F.lit(f"(?i){p}") for p in spec.get("skip_patterns", [])]
    skipped = F.lit(0.0)
    if skip:
        is_skipped = lambda r: F.greatest(*[F.rlike(r["m"], p).cast("int") for p in skip], F.lit(0)) == 1
        amounts = lambda name: F.transform(F.filter(rows, is_skipped), lambda r: F.coalesce(typed(raw(r)[name], spec.get("types", {}).get(name, "currency")).cast("double"), F.lit(0.0)))
        for name in (n for n in ("total_cost", "line_total") if n in fields):
            skipped = skipped + F.aggregate(amounts(name), F.lit(0.0), lambda a, x: a + x)
        rows = F.filter(rows, lambda r: ~is_skipped(r))
    out = _items(rows, spec, raw)
    left = text
    for extra in spec.get("extra_patterns", []):
        left = F.regexp_replace(left, _many(spec["pattern"]), "")
        own = {**spec, "field_map": extra.get("field_map", fields), "generated_fields": {}, "clean_fields": {}}
        own_raw = lambda r, own=own: {n: F.nullif(r[f"g{g}"], F.lit("")) for n, g in own["field_map"].items()}
        out = F.concat(out, _items(_matches(left, extra["pattern"], own["field_map"].values()), own, own_raw))
    return out, skipped


def _block_items(text: Column, spec: dict) -> tuple[Column, Column]:
    """One item a block: from a match of ``start`` to the next. Each field is the first group of its pattern in the block."""
    blocks = F.filter(F.split(text, f"(?m)(?={spec['start']})"), lambda b: F.rlike(b, F.lit(f"(?m)\\A{spec['start']}")))
    raw = lambda b: {n: F.nullif(F.regexp_extract(b, _many(p), 1), F.lit("")) for n, p in spec["fields"].items()}
    return _items(blocks, {**spec, "field_map": spec["fields"]}, raw), F.lit(0.0)


def _table_items(text: Column, spec: dict) -> tuple[Column, Column]:
    """One item a delimited line of enough cells; header and summary rows go."""
    fields = spec["field_map"]
    rows = F.transform(F.split(text, "\n"), lambda line: F.transform(F.split(line, spec.get("delimiter", "\t")), lambda c: F.trim(c)))
    heads = [n.lower() for n in spec.get("header", list(fields))]
    is_head = lambda r: F.size(F.filter(r, lambda c: F.lower(c).isin(heads))) * 2 >= len(heads)
    rows = F.filter(rows, lambda r: (F.size(r) >= max(fields.values())) & ~is_head(r) & ~F.rlike(F.get(r, F.lit(0)), F.lit("(?i)^(sub)?total|^balance|^amount due")))
    return _items(rows, spec, lambda r: {n: F.nullif(F.get(r, F.lit(g - 1)), F.lit("")) for n, g in fields.items()}), F.lit(0.0)


STRATEGIES = {"line": _line_items, "block": _block_items, "table": _table_items}


def _part(body: Column, spec: dict) -> Column:
    """The section of a clean text that has the items."""
    return section(body, spec["section"]["start"], spec["section"].get("ends", ["\x00"])) if "section" in spec else body


def _branch(body: Column, spec: dict, part: Column | None = None) -> Column:
    """What a document of this format is parsed to; ``part`` is the section of its clean text, if known."""
    part = _part(body, spec) if part is None else part
    metadata = []
    for name, m in spec.get("metadata", {}).items():
        metadata += [F.lit(name), typed(field(body, m["patterns"]), m.get("type", "string")).cast("string")]
    found = F.map_filter(F.create_map(*metadata), lambda _, v: v.isNotNull()) if metadata else F.create_map().cast("map<string,string>")
    strategy = spec["items"].get("strategy", "line")
    if strategy not in STRATEGIES:
        raise SpecError(f"unknown strategy {strategy!r}")
    items, skipped = STRATEGIES[strategy](part, spec["items"])
    return F.struct(found.alias("metadata"), items.alias("items"), F.round(skipped, 2).alias("skipped_total"))


def parsed(docs: DataFrame, specs: Iterable[dict | str], ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident``, format, metadata (map), items (array) and skipped_total of every document; nulls for those of no format."""
    ordered = registered(specs)
    if not ordered:
        return docs.select(ident, F.lit(None).cast("string").alias("format"), F.lit(None).cast("map<string,string>").alias("metadata"), F.lit(None).cast(f"array<{ITEM}>").alias("items"), F.lit(None).cast("double").alias("skipped_total"))
    detect = lambda s, k: list(s.get("detect", {}).get(k, []))
    rows = [(s["name"], s["priority"], detect(s, "all_of"), detect(s, "any_of"), detect(s, "none_of")) for s in ordered]
    table = docs.sparkSession.createDataFrame(rows, "name string, priority int, all_of array<string>, any_of array<string>, none_of array<string>")
    known = format_detected(docs.select(ident, text), table, text)
    # each step is a column of its own, as an expression is computed wherever it is named
    of_format = lambda make: F.coalesce(*[F.when(F.col("format") == s["name"], make(s)) for s in ordered])
    clean = known.withColumn("__body", of_format(lambda s: cleaned(F.col(text), s.get("clean", []))))
    cut = clean.withColumn("__part", of_format(lambda s: _part(F.col("__body"), s)))
    found = of_format(lambda s: _branch(F.col("__body"), s, F.col("__part")))
    return cut.select(ident, "format", found.alias("p")).select(ident, "format", "p.metadata", "p.items", "p.skipped_total")


def items_of(documents: DataFrame, ident: str = "doc_id") -> DataFrame:
    """One row an item: ``ident``, format, item (from 1) and the item's fields."""
    # the outer form, as a filter for empty arrays would be pushed below what makes them, which is computed twice then
    rows = documents.select(ident, "format", F.posexplode_outer("items").alias("at", "i")).filter(F.col("at").isNotNull())
    return rows.select(ident, "format", (F.col("at") + 1).alias("item"), "i.*")


#: Amounts of an invoice's head, by their keys in a result; 0 where there is none (fixed values).
HEAD_AMOUNTS = {
    "invoice_total": "total", "sub_total": "sub_total", "freight": "freight", "tax": "tax", "discount": "discount", "savings": "savings", "credits": "credits", "free_shipping": "free_shipping",
    "other_cost": "other_cost", "skipped_items_total": "skipped_items_total",
}
#: Texts of the head, and of an item, by their keys; empty where there is none.
HEAD_TEXTS = {"invoice_num": "invoice_number", "invoice_date": "date", "po_number": "po_number", "country_code": "country_code", "supplier_name": "supplier", "supplier_address": "supplier_address"}
ITEM_TEXTS = {"supplier_item": "sku", "description": "description", "catalog_num": "catalog_num", "legacy_sku": "legacy_sku", "data_quality": "data_quality"}


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _first_key(value: Column, keys: tuple[str, ...]) -> Column:
    """The number under the first key that is there, even if it is null there; 0 if none is."""
    there = F.coalesce(*[_get(value, f"$.{k}", "variant") for k in keys])
    return F.when(there.isNull(), F.lit(0.0)).otherwise(_get(there, "$", "double"))


def normalised(results: DataFrame, ident: str = "doc_id", result: str = "result") -> DataFrame:
    """Parsers' results (JSON of any keys) in one schema: ``ident``, the head's texts and amounts, format, and items.

    Of a result's invoices the first counts. An item's total is under total_cost, else total; its price under unit_cost, else unit_price. Items of no
    quantity and no value go. A result that isn't a success, has no invoices or can't be read has an empty head and no items.
    """
    v = F.try_parse_json(result)
    ok = F.coalesce(_get(v, "$.status", "string") == "success", F.lit(False))
    rows = results.withColumn("__v", F.when(ok, v)).withColumn("__inv", _get(F.col("__v"), "$.invoices[0]", "variant"))
    inv = F.col("__inv")
    items = F.filter(F.coalesce(_get(inv, "$.items", "array<variant>"), F.array().cast("array<variant>")), lambda i: ~((_first_key(i, ("quantity",)).eqNullSafe(F.lit(0.0))) & (F.coalesce(_first_key(i, ("total_cost", "total")), F.lit(0.0)) == 0)))
    made = F.transform(items, lambda i: F.struct(
        *[F.coalesce(_get(i, f"$.{k}", "string"), F.lit("")).alias(n) for n, k in ITEM_TEXTS.items()],
        _first_key(i, ("quantity",)).alias("quantity"), _first_key(i, ("unit_cost", "unit_price")).alias("unit_price"), _first_key(i, ("total_cost", "total")).alias("total"),
    ))
    return rows.select(
        ident,
        *[F.coalesce(_get(inv, f"$.{k}", "string"), F.lit("")).alias(n) for n, k in HEAD_TEXTS.items()],
        *[F.coalesce(_get(inv, f"$.{k}", "double"), F.lit(0.0)).alias(n) for n, k in HEAD_AMOUNTS.items()],
        F.coalesce(_get(inv, "$.invoice_total_uncertain", "boolean"), F.lit(False)).alias("invoice_total_uncertain"),
        F.coalesce(_get(F.col("__v"), "$.format", "string"), F.lit("unknown")).alias("format"),
        made.alias("items"),
    )

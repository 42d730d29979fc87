"""Items of documents by the state that lines leave behind: sections that headers open and totals close, and blocks of lines that belong together."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Section:
    """``header`` opens a section; a line that begins with one of ``page_marks`` or ``total_marks``, or a page number, closes it. In a section ``item``
    begins an item, whose ``fields`` are groups; ``upc`` gives the code of the item before it; other lines go on with the description, if
    ``continues``."""

    header: str
    item: str
    fields: dict[str, int] = field(default_factory=dict)
    page_marks: tuple[str, ...] = ()
    total_marks: tuple[str, ...] = ()
    upc: str | None = None
    continues: bool = False
    drop_free_parts: bool = False
    drop_no_quantity: bool = False


WHOLE, AMOUNTS = ("quantity", "ordered"), ("unit_price", "total")


def _starts(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.startswith(text, F.lit(m))
    return out


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def section_items(lines: DataFrame, s: Section, group: str = "doc_id", order: str = "line_no", text: str = "line") -> DataFrame:
    """``group``, item (from 1), the section's text fields, quantity, unit_cost, total_cost, description and upc. Numbers that can't be read are 0; a missing
    total is quantity times price. Blank and null lines don't count."""
    own = F.trim(F.col(text))
    rows = lines.select(group, order, own.alias("t")).filter(F.col("t") != "")
    t, w = F.col("t"), Window.partitionBy(group).orderBy(order)
    opens = t.rlike(f"(?i){s.header}")
    closes = _starts(t, s.page_marks) | t.rlike(r"^Page\s+\d+\s+of\s+\d+") | _starts(t, s.total_marks)
    rows = rows.withColumn("__event", F.when(opens, 1).when(closes, 0))
    inside = F.last("__event", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) == 1
    rows = rows.withColumn("__in", inside).filter(F.col("__event").isNull() & F.col("__in"))
    is_upc = t.rlike(f"^(?:{s.upc})") if s.upc else F.lit(False)
    kind = F.when(is_upc, "upc").when(F.startswith(t, F.lit("·")) | F.startswith(t, F.lit("•")), "mark").when(t.rlike(f"^(?:{s.item})"), "item").otherwise("more")
    rows = rows.withColumn("__kind", kind)
    rows = rows.withColumn("item", F.sum((F.col("__kind") == "item").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("item > 0")
    of_item = lambda g: F.max(F.when(F.col("__kind") == "item", F.regexp_extract("t", f"^(?:{s.item})", g)))
    more = F.transform(F.array_sort(F.collect_list(F.when(F.col("__kind") == "more", F.struct(order, "t")))), lambda r: r["t"])
    upc = F.max_by(F.when(F.col("__kind") == "upc", F.regexp_extract("t", s.upc, 1)), F.when(F.col("__kind") == "upc", F.col(order))) if s.upc else F.lit(None).cast("string")
    made = rows.groupBy(group, "item").agg(*[of_item(g).alias(f"__{n}") for n, g in s.fields.items()], more.alias("__more"), upc.alias("upc"))
    raw = lambda n: F.col(f"__{n}") if n in s.fields else F.lit(None).cast("string")
    whole = lambda n: F.coalesce(F.floor(_number(raw(n))).cast("long"), F.lit(0))
    quantity, unit = whole("quantity"), F.coalesce(_number(raw("unit_price")), F.lit(0.0))
    total = F.coalesce(F.when(F.nullif(raw("total"), F.lit("")).isNotNull(), F.coalesce(_number(raw("total")), F.lit(0.0))), F.round(quantity * unit, 2))
    texts = [F.trim(raw(n)).alias(n) for n in s.fields if n not in (*WHOLE, *AMOUNTS, "description")]
    described = F.coalesce(F.nullif(F.trim(raw("description")), F.lit("")), F.lit(""))
    description = F.array_join(F.filter(F.concat(F.array(described), F.col("__more") if s.continues else F.array().cast("array<string>")), lambda x: x != ""), " ")
    out = made.select(group, "item", *texts, quantity.alias("quantity"), unit.alias("unit_cost"), total.alias("total_cost"), description.alias("description"), "upc")
    if s.drop_free_parts and "line_number" in s.fields:
        out = out.filter((F.col("total_cost") > 0) | ~F.contains("line_number", F.lit(".")))
    return out.filter("quantity > 0") if s.drop_no_quantity else out


#: What begins lines that are no product (fixed values).
NO_PRODUCT = ("Order #", "Date Placed:", "Subtotal:", "Total:", "Shipping:", "Discount:", "Payment method:", "Delivery Address:", "Billing Address:", "FASHION", "Visit:", "Shop:")


def priced_products(lines: DataFrame, group: str = "doc_id", order: str = "line_no", text: str = "line", prefix: str = "FN-") -> DataFrame:
    """``group``, item, sku, description, quantity, unit_cost and total_cost of products whose next line is their price; the third line after a product may
    have its quantity (else 1). A product's line has ten characters or more, begins with a letter and has no colon."""
    w = Window.partitionBy(group).orderBy(order)
    t = F.coalesce(F.trim(F.col(text)), F.lit(""))
    rows = lines.select(group, order, t.alias("t")).withColumns({"__price": F.lead("t", 1).over(w), "__quantity": F.lead("t", 3).over(w)})
    product = (F.length("t") >= 10) & ~F.contains("t", F.lit(":")) & F.col("t").rlike(r"^\p{L}") & F.col("t").rlike("[A-Za-z]") & ~_starts(F.col("t"), NO_PRODUCT)
    price = F.when(F.startswith("__price", F.lit("Price:")), _number(F.regexp_extract("__price", r"Price:\s*\$?([\d,]+\.\d{2})", 1)))
    quantity = F.coalesce(F.when(F.startswith("__quantity", F.lit("Qty:")), F.regexp_extract("__quantity", r"Qty:\s*(\d+)", 1).try_cast("int")), F.lit(1))
    found = rows.filter(product).select(group, order, F.col("t").alias("description"), quantity.alias("quantity"), price.alias("unit_cost")).filter("unit_cost IS NOT NULL")
    item = F.row_number().over(w)
    return found.select(group, item.alias("item"), F.concat(F.lit(prefix), item).alias("sku"), "description", "quantity", "unit_cost", F.round(F.col("unit_cost") * F.col("quantity"), 2).alias("total_cost"))

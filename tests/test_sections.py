from __future__ import annotations

from tradeloom.operators import sections as S
from tradeloom.plans.sections import SPEC

DDL = "doc_id int, line_no int, line string"


def frame(spark, *docs):
    return spark.createDataFrame([(d, n, line) for d, text in enumerate(docs) for n, line in enumerate(text)], DDL)


def test_sections_open_and_close(spark):
    rows = S.section_items(frame(spark, [
        "1 early 2 x 3.00", "ln item qty", "1 a 2 x 3.00", "Total", "2 b 2 x 3.00", "UPC: 7", "Ln Item Qty", "goes on", "UPC: 8", "UPC 9", "3 c bad x 1.00 = 4.00", "", None, "·x", "4.1 d 1 x 0.00", "4 e 1 x 0.00",
    ], ["Ln Item Qty"], []), SPEC).orderBy("item").collect()
    assert [(r.doc_id, r.sku, r.quantity, r.unit_cost, r.total_cost, r.description, r.upc) for r in rows] == [(0, "a", 2, 3.0, 6.0, "goes on 3 c bad x 1.00 = 4.00", "9"), (0, "e", 1, 0.0, 0.0, "", None)]


def test_plain_section(spark):
    plain = S.Section(header="^Items", item=r"(\S+) (\S+)", fields={"description": 1, "total": 2})
    rows = S.section_items(frame(spark, ["Items", "bolt x", "nut 1,000.50 rest", "other"]), plain).orderBy("item").collect()
    assert [(r.description, r.total_cost, r.quantity, r.upc) for r in rows] == [("bolt", 0.0, 0, None), ("nut", 1000.5, 0, None)]
    assert S.section_items(frame(spark, ["x"]).limit(0), plain).count() == 0


def test_products_with_prices(spark):
    rows = S.priced_products(frame(spark, ["Nice dress one", "Price: $1,010.00", "Size: S", "Qty: 2", "Nice dress two", "", "Price: $1.00", "9 nice dresses", "Price: 2.00", "short", "Price: 1.00", "Nice dress four", "Price: 3", "Shop: nice dress", "Price: 1.00", None, "Nice dress five", "Price: 4.00"])).orderBy("item").collect()
    assert [(r.sku, r.description, r.quantity, r.total_cost) for r in rows] == [("FN-1", "Nice dress one", 2, 2020.0), ("FN-2", "Nice dress five", 1, 4.0)]

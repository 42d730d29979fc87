from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from tradeloom.operators.reconcile import tax_pivot
from tradeloom.sources import readers, sinks

XML = """<Declaration><Item><Item_number>1</Item_number><Commodity_code>123456</Commodity_code><Description>A</Description><CIF_value>10.5</CIF_value>
<Tax><Code>CET</Code><Amount>2.10</Amount></Tax><Tax><Code>VAT</Code><Amount>1.5</Amount></Tax></Item><Item><Item_number>2</Item_number><Commodity_code>8712.00.90</Commodity_code></Item></Declaration>"""


def test_declarations(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    items = readers.declaration_items(spark, str(tmp_path))
    assert [(r.item_id, r.tariff_code, r.cif) for r in items.orderBy("item_id").collect()] == [(1, "12345600", Decimal("10.50")), (2, "87120090", None)]
    wide = tax_pivot(readers.tax_lines(items), ["CET", "VAT", "EXT"]).first()
    assert (wide.CET, wide.VAT, wide.EXT) == (Decimal("2.10"), Decimal("1.50"), None)


def test_journal_skips_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in readers.journal(spark, str(tmp_path), "a int").collect()) == [1, 2]


def test_order_layouts(spark):
    classic = spark.createDataFrame(
        [("s", 1, "Acme", "PO/GD/1 (A1/ B2)", "[X-1] Bolt", Decimal(2), Decimal("1.50")), ("s", 2, None, None, "Nut", Decimal(1), Decimal(4)), ("s", 3, "Other", "PO/2", None, None, None)],
        "sheet string, row int, partner string, reference string, description string, demand decimal(18,4), price decimal(18,4)",
    )
    got = readers.classic_orders(classic).orderBy("row").collect()
    assert [(r.supplier, r.po_number, r.invoice_refs, r.supplier_sku, r.description, r.total) for r in got] == [("Acme", "PO/GD/1", ["A1", "B2"], "X-1", "Bolt", Decimal("3.00")), ("Acme", "PO/GD/1", ["A1", "B2"], None, "Nut", Decimal("4.00"))]
    commercial = spark.createDataFrame([("s", 1, "I9", "Acme", "Bolt", Decimal(2), Decimal(3)), ("s", 2, None, None, "Nut", Decimal(1), Decimal(1)), ("s", 3, None, None, None, None, None)], "sheet string, row int, number string, partner string, product string, quantity decimal(18,4), price decimal(18,4)")
    assert [(r.po_number, r.total) for r in readers.commercial_orders(commercial).orderBy("row").collect()] == [("I9", Decimal("6.00")), ("I9", Decimal("1.00"))]
    heads = spark.createDataFrame([(["Number", "Invoice Lines/Product"],), (["Partner"],)], "h array<string>")
    assert [r[0] for r in heads.select(readers.layout(F.col("h"))).collect()] == ["commercial_invoice", "classic"]


def test_bills(spark):
    texts = spark.createDataFrame([(1, "B/L No: HAWB12345\nConsignee: Jo Soap\n3 PACKAGES\n2 cartons\nTotal 5 packages\nInvoices: A1,\n B2, C3\n1,000 LBS"), (2, "nothing"), (3, "BL# HAWB12345 9 pkgs Invoice: Z1")], "id int, text string")
    got = {r.id: r for r in readers.bills_of_lading(texts).collect()}
    assert (got[1].bl_number, got[1].consignee, got[1].packages, got[1].weight_kg, got[1].refs) == ("HAWB12345", "Jo Soap", 5, 453, ["A1", "B2", "C3"])
    assert (got[2].bl_number, got[2].packages, got[2].weight_kg, got[2].refs) == (None, 1, None, [])
    merged = readers.supplementary_merged(readers.bills_of_lading(texts)).collect()
    assert [(r.bl_number, r.packages, r.weight_kg, r.refs) for r in merged] == [("HAWB12345", 9, 453, ["A1", "B2", "C3", "Z1"])]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, Decimal(2), Decimal(3), Decimal(7)), (2, Decimal(1), Decimal(1), Decimal(1))], "shipment int, quantity decimal(18,4), unit_cost decimal(18,4), total_cost decimal(18,2)")
    sheet = sinks.worksheet(rows)
    assert tuple(sheet.columns) == sinks.WORKSHEET and [r.variance for r in sheet.collect()] == [Decimal("1.00"), Decimal("0.00")]
    out = str(tmp_path / "t")
    sinks.write_table(rows, out, ["shipment"], rows_per_file=1)
    sinks.replace_partitions(rows.filter("shipment = 2").withColumn("total_cost", F.lit(9).cast("decimal(18,2)")), out, ["shipment"])
    assert sorted((r.shipment, r.total_cost) for r in spark.read.parquet(out).collect()) == [(1, 7), (2, 9)]
    sinks.write_csv(rows, str(tmp_path / "c"))
    sinks.write_journal(rows, str(tmp_path / "j"))
    sinks.write_journal(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4

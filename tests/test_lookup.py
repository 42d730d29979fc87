from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from tradeloom.operators import lookup as L

M = "decimal(18,2)"


def test_one_digit_is_changed(spark):
    rows = spark.createDataFrame(
        [(1, 100, 7, 107), (2, 100, 9, 107), (3, 100, 7, 167), (4, 100, 55, 107), (5, None, 7, 107), (6, 0, 0, 5)], "id int, subtotal int, tax int, total int"
    ).select("id", *[F.col(c).cast(M).alias(c) for c in ("subtotal", "tax", "total")])
    got = {r.id: (r.tax, r.total, r.fixed) for r in L.digit_fixed(rows).collect()}
    assert got[1] == (7, 107, None) and got[2] == (7, 107, "tax") and got[3] == (Decimal("67.00") if got[3][2] == "tax" else 7, got[3][1], got[3][2])
    assert got[4][2] is None and got[5][2] is None and got[6][2] == "total"
    for r in L.digit_fixed(rows).filter("fixed is not null").collect():
        assert r.subtotal + r.tax == r.total


def test_arithmetic(spark):
    rows = spark.createDataFrame([(1, 7, 2, 10), (2, 4, 3, 10), (3, 4, 9, 10), (4, 0, 0, 5)], "id int, quantity int, unit_cost int, total_cost int")
    got = {r.id: (r.quantity, r.unit_cost, r.how) for r in L.arithmetic_fixed(rows).collect()}
    assert got == {1: (5, 2, "quantity"), 2: (4, Decimal("2.5"), "cost"), 3: (4, 9, "open"), 4: (0, 0, "open")}


def test_fields(spark):
    docs = spark.createDataFrame([("Ref: A1 $5.00 fee 1,000.50 $0.00 $ 2.25",), ("none",), (None,)], "t string")
    got = docs.select(L.field(F.col("t"), [r"No: (\w+)", r"Ref: (\w+)"], "?"), L.field_sum(F.col("t"), [r"fee ([\d,.]+)", r"\$([\d.]+)"]), L.charges(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("A1", Decimal("1005.50"), [Decimal("5.00"), Decimal("2.25")]), ("?", Decimal("0.00"), []), ("?", None, None)]


def test_states(spark):
    updates = spark.createDataFrame([("m", 1, "new", None), ("m", 2, None, 1), ("m", 3, "failed", None), ("n", 1, "done", 9)], "k string, n int, status string, retry_count int")
    states = L.latest_status(updates, "k", ["n"], ["status", "retry_count"])
    assert sorted(tuple(r) for r in states.collect()) == [("m", "failed", 1, 3), ("n", "done", 9, 1)]
    assert [r.k for r in L.resumable(states, ["failed", "done"]).collect()] == ["m"]


def test_suppliers(spark):
    s = spark.createDataFrame([(1, "Acme", "AC"), (2, "Acme Tools", "AT")], "supplier_id int, name string, code string")
    names = spark.createDataFrame([("at",), ("ACME",), ("Acme Tools Ltd",), ("nobody",)], "name string")
    assert {r.name: (r.supplier_id, r.tier) for r in L.supplier_found(names, s).collect()} == {"at": (2, 1), "ACME": (1, 2), "Acme Tools Ltd": (1, 3)}

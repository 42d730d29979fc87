from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tradeloom.operators import specs as S

LINE = {"name": "a", "detect": {"any_of": ["A"]}, "items": {"pattern": r"^(\w+) (\d+) ([\d.]+)$", "field_map": {"description": 1, "quantity": 2, "total_cost": 3}, "types": {"quantity": "integer", "total_cost": "currency"}}}


def generated(**fields):
    return {**LINE, "items": {**LINE["items"], "generated_fields": fields}}


def items(spark, spec, text):
    return S.items_of(S.parsed(spark.createDataFrame([(1, text)], "doc_id int, text string"), spec if isinstance(spec, list) else [spec])).orderBy("item").collect()


@pytest.mark.parametrize(("expression", "value"), [("total_cost / quantity", 2.5), ("-(total_cost + 2) * 0.5", -6.0), ("index + quantity - 1", 4.0), ("total_cost / (quantity - 4)", None), ("total_cost / quantity / 2 + 1", 2.25)])
def test_expressions(spark, expression, value):
    assert items(spark, generated(unit_cost=expression), "A\nbolt 4 10.00")[0].unit_cost == value


@pytest.mark.parametrize("expression", ["__import__('os') + 1", "total_cost ** 2 + 1", "description + 1", "unknown * 2", "quantity + ", "[1][0] + 1", "(lambda: 1)() + 1", "'a' * 3", "True + 1", "quantity if 1 + 1 else 2", "total_cost.real + 1"])
def test_refusals(spark, expression):
    with pytest.raises(S.SpecError):
        items(spark, generated(unit_cost=expression), "A\nbolt 4 10.00")


def test_templates(spark):
    row = items(spark, generated(sku="X-{index:03d}-{description}", note="{missing} of {index}", plain=7, tail="no braces"), "A\nbolt 4 10.00\nnut 1 2.00")[1]
    assert row.sku == "X-002-nut" and row.attributes == {"note": "{missing} of {index}", "plain": "7", "tail": "no braces"}


def test_order_of_specs():
    made = S.registered([{"name": "b", "source": "auto", "x": 1}, {"name": "b", "x": 2}, json.dumps({"name": "c", "priority": 3}), {"name": "a"}, {"name": "a", "x": 9}, {"name": "z", "source": "auto"}])
    assert [(s["name"], s["priority"]) for s in made] == [("c", 3), ("a", 0), ("b", 0), ("z", -10)] and made[2]["x"] == 2 and "x" not in made[1]
    with pytest.raises(S.SpecError):
        S.registered([{"name": str(i)} for i in range(S.MOST_SPECS + 1)])
    with pytest.raises(S.SpecError):
        S._branch(F.lit("x"), {"name": "a", "items": {"strategy": "guess"}})


def test_a_spec_is_added_at_run_time(spark):
    table = spark.createDataFrame([(json.dumps(LINE),)], "spec string")
    text = "A B\nbolt 4 10.00"
    assert items(spark, S.specs_of(table), text)[0].description == "bolt"
    more = table.union(spark.createDataFrame([(json.dumps({"name": "b", "priority": 1, "detect": {"all_of": ["B"]}, "items": {"strategy": "table", "delimiter": " ", "field_map": {"sku": 1}}}),)], "spec string"))
    assert items(spark, S.specs_of(more), text)[1].sku == "bolt"


def test_one_plan_for_all_specs(spark):
    docs = spark.createDataFrame([(1, "A\nbolt 4 10.00"), (2, "C"), (3, None), (4, "")], "doc_id int, text string")
    frame = S.parsed(docs, [LINE, {**LINE, "name": "c", "detect": {"any_of": ["C"]}}])
    assert frame._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD[doc_id") == 1
    got = {r.doc_id: r for r in frame.collect()}
    assert len(got[1]["items"]) == 1 and got[2]["items"] == [] and got[3].format is None and got[3]["items"] is None and got[4].format is None
    assert S.parsed(docs, []).count() == 4 and S.parsed(docs.limit(0), [LINE]).count() == 0


def test_replacements_name_groups():
    assert S._replacement(r"\1.\2") == "$1.$2" and S._replacement(r"$\1") == r"\$$1" and S._replacement("$") == r"\$" and S._replacement("x") == "x"


def test_skipped_totals_and_leftovers(spark):
    spec = {**LINE, "items": {**LINE["items"], "skip_patterns": ["^void"], "extra_patterns": [{"pattern": r"^Fee ([\d.]+) (\w+)$", "field_map": {"total_cost": 1, "description": 2}}]}}
    docs = spark.createDataFrame([(1, "A\nbolt 4 10.00\nVOID 1 3.50\nvoid 1 1.00\nFee 2.00 port")], "doc_id int, text string")
    row = S.parsed(docs, [spec]).first()
    assert row.skipped_total == 4.5 and [(i.description, i.total_cost) for i in row["items"]] == [("bolt", 10.0), ("port", 2.0)]


@pytest.mark.parametrize(
    ("result", "head", "kept"),
    [
        ('{"status":"success","format":"f","invoices":[{"invoice_number":"N","total":null,"items":[{"sku":"s","quantity":0,"total":5},{"quantity":0},{"quantity":null,"total_cost":null,"total":9},{"unit_price":2,"quantity":"3"}]}]}', ("N", 0.0, "f"), [("s", 0.0, 0.0, 5.0), ("", None, 0.0, None), ("", 3.0, 2.0, 0.0)]),
        ('{"status":"success","format":"f","invoices":[]}', ("", 0.0, "f"), []),
        ('{"status":"error","format":"f"}', ("", 0.0, "unknown"), []),
        ("{not json", ("", 0.0, "unknown"), []),
        (None, ("", 0.0, "unknown"), []),
        ('[1]', ("", 0.0, "unknown"), []),
    ],
)
def test_results_in_one_schema(spark, result, head, kept):
    row = S.normalised(spark.createDataFrame([(1, result)], "doc_id int, result string")).first()
    assert (row.invoice_num, row.invoice_total, row.format) == head
    assert [(i.supplier_item, i.quantity, i.unit_price, i.total) for i in row["items"]] == kept

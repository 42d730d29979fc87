from __future__ import annotations

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tradeloom.operators import heads as H
from tradeloom.operators import migration as G
from tradeloom.operators import supertext as T
from tradeloom.operators.ordering import Reading, _plain
from tradeloom.plans import stores
from tradeloom.plans.order import TRUST, _readings


def plainly_merged(variants, priority):
    """Every line compared with every line kept."""
    price = Reading().price
    import re

    base = max(variants, key=lambda v: (sum(len(re.findall(price, t)) for t in variants[v]), sum(len(t) + 1 for t in variants[v]), priority.get(v, 0), v))
    out = list(variants[base])
    for v in sorted(variants):
        for t in variants[v] if v != base else []:
            if T.sensible(t) and all(SequenceMatcher(None, _plain(t), _plain(o)).ratio() <= 0.80 for o in out):
                out.append(t.strip())
    return out


def test_super_text_of_all_turns(spark, sf):
    rows = _readings(spark, sf).orderBy("doc_id", "variant", "line_no").collect()
    docs = {}
    for r in rows:
        if r.text and r.text.strip():
            docs.setdefault(r.doc_id, {}).setdefault(r.variant, []).append(r.text)
    got = {}
    for r in stores.super_text(spark, sf).orderBy("doc_id", "line").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {d: plainly_merged(v, TRUST) for d, v in docs.items()}


def test_alike_is_the_ratio_of_all():
    rng = random.Random(2)
    words = ["bolt", "nut", "washer", "12.50", "qty", "é", "漢字", "a", "steel plate"]
    lines = [" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(300)] + [""]
    known, kept = T.Alike(), []
    for line in lines:
        assert known.has_like(line) == any(SequenceMatcher(None, line, o).ratio() > 0.80 for o in kept)
        known.add(line)
        kept.append(line)


@pytest.mark.parametrize(("line", "expected"), [("abc", False), ("x $12.50", True), ("12 ab", True), ("12,34 - 5", True), ("1" * 40, False), ("SRS Aaa rT Sis ae nena", False), ("steel washers", True), ("one nut that fits", False), ("!!!! washers ####", False), ("", False), ("   ", False)])
def test_sensible(line, expected):
    assert T.sensible(line) is expected


def test_super_text_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "a", 0, None), (1, "a", 1, "  "), (2, "b", 0, "steel washers 12"), (2, "b", 1, ""), (2, "c", 0, "steel  WASHERS 12"), (2, "c", 1, "brand new line 77"), (2, "c", 2, "brand new line 77")], "doc_id long, variant string, line_no int, text string")
    assert sorted(map(tuple, T.super_text(rows, {}).collect())) == [(2, 0, "steel  WASHERS 12"), (2, 1, "brand new line 77"), (2, 2, "brand new line 77")]
    assert T.super_text(rows.limit(0), {}).count() == 0


def head(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def test_rates(spark):
    assert head(spark, H.conversion_rate, None) is None and head(spark, H.conversion_rate, "1 CNY = 0.1 USD") is None  # three decimals at least
    r = head(spark, H.conversion_rate, "1 USD = 7.2000 CNY and 1 CNY = 0.1388 USD")
    assert (r.source, r.rate, r.raw) == ("CNY", 0.1388, "1 CNY = 0.1388 USD")
    assert head(spark, H.conversion_rate, "1 CNY = 0.000 USD") is None
    r = head(spark, H.conversion_rate, "10.00 Chinese Yuan x\n1.40 US Dollars\n10.00 CHINESE YUAN\n\n\nis 2.00 US dollars\n1,0.0.0 Chinese Yuan\n5.00 US Dollars")
    assert (r.samples, r.rate, r.date) == (2, 0.2, None)


def test_manifests(spark):
    assert head(spark, H.manifest, None) is None and head(spark, H.manifest, "Consignee: A") is None
    m = head(spark, H.manifest, "Asycuda\nWayBill Number: X1\nGross .\nConsignee: Notify: CARIB CO\nnotify me\nHILLS PHARMACY (FREIGHT 17.00 US)\nWayBill")
    assert m.waybill == "X1" and m.weight is None and m.consignee_name == "HILLS PHARMACY" and m.consignee_address is None


def test_stores_are_moved_once(spark):
    assessed = spark.createDataFrame([(json.dumps({"entries": {"_metadata": {}, "steel bolt": {"code": "73181500", "count": 3, "total": 4, "sources": ["x"]}, "no code": {"code": ""}}}),), (json.dumps({"brass nut": {"code": "74153300", "confidence": 0.7}}),), ("not json",), (None,)], "json string")
    cache = spark.createDataFrame([(json.dumps({
        "__asycuda_1": {"code": "1"}, "a": {"original_description": "Steel Bolt", "code": "73180000"}, "b": {"original_description": "Brass Nut", "code": "99990000"}, "c": {"original_description": "!!", "code": "1"},
        "plastic cap": {"code": "39235000", "source": "llm", "verified_against_assessed": True}, "empty": {"code": ""},
    }),), ("{}",)], "json string")
    empty = G.assessed_rows(assessed).limit(0)
    once = G.migrated(empty, assessed, cache)
    rows = {(r.description_norm, r.tariff_code): r for r in once.collect()}
    assert set(rows) == {("steel bolt", "73181500"), ("brass nut", "74153300"), ("steel bolt", "73180000"), ("plastic cap", "39235000")}
    assert rows["plastic cap", "39235000"].unverified == 0 and rows["steel bolt", "73181500"].notes == "count=3/4" and rows["steel bolt", "73180000"].confidence == 0.5
    twice = G.migrated(once, assessed, cache)
    assert sorted(map(tuple, twice.collect()), key=repr) == sorted(map(tuple, once.collect()), key=repr)
    assert {r.description_norm: r.tariff_code for r in G.lookup(once).collect()} == {"steel bolt": "73180000", "brass nut": "74153300", "plastic cap": "39235000"}

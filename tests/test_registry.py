"""Registered queries against their SQL in another engine, and the driver's contract."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tradeloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, decimal.Decimal)) or isinstance(v, int) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, con, name):
    frame = registry.queries()[name](spark, sf)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    if name not in registry.oracle_sql():
        assert got
        return
    result = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert got == rows(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert registry.FLAGSHIP in registry.queries()


@pytest.mark.parametrize(("name", "key"), [("po_greedy_assign", "invoice_id"), ("officer_match", "shipment_id")])
def test_all_invoices_are_matched(spark, sf, name, key):
    found = {r[0] for r in registry.queries()[name](spark, sf).select(key).distinct().collect()}
    assert found == {r[0] for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().collect()}

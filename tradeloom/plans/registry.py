"""All registered queries of the trade-document operators."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package that have QUERIES and SQL.
MODULES: tuple[str, ...] = ("totals", "scalars", "classify", "order", "records", "lookups", "parse", "review", "streams", "checklist", "splits", "specs", "flows", "stores", "files", "sections")
FLAGSHIP = "group_totals"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f"tradeloom.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"tradeloom.plans.{m}").SQL.items()}

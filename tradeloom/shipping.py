"""Sends this package to the executors of a session that can't import it from their own path."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package as a zip file, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SENT:
        root = Path(__file__).resolve().parent
        made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='tradeloom-zip-')}/{root.name}", "zip", root.parent, root.name)
        sc.addPyFile(made)
        _SENT.add(sc.applicationId)
    return spark


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
        return query(ship(spark), *args, **kwargs)

    return run

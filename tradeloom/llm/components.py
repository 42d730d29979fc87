"""Connected components of large graphs by alternating stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.llm.common import by_share, removed, stored, written

MAX_ROUNDS = 60
#: Edges in one partition between rounds; with fewer, a round's many exchanges would be of nearly empty files.
ROWS_PER_PART = 50_000


def _with_least(edges: DataFrame, rows: int) -> DataFrame:
    """``edges`` (u, v; about ``rows``) with the smallest v of each u as m. The minima of hubs are broadcast, others are joined by u."""
    return by_share(edges, edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n")), "u", "__n", rows)


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour (or itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * rows).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_least(down, rows)
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node in ``edges`` (u, v: long, not null).

    Loops and repeated edges are allowed; nodes without an edge are not listed. Minima are pre-aggregated, the joins are on
    the node with one row on one side, and each round is written to the shared folder (the one before is deleted), so nothing depends on a single executor. A round
    never has more edges than the first had, and rounds grow with the square of the logarithm of the nodes at most.
    """
    spark = edges.sparkSession
    now, path = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if mark == before:
            break
        before = mark
        parts = max(8, mark[0] // ROWS_PER_PART)
        large, large_path = stored(_large_star(now, mark[0]).filter("u <> v").distinct().coalesce(parts), "large-star")
        after, after_path = stored(_small_star(large, mark[0]).filter("u <> v").distinct().coalesce(parts), "small-star")
        removed(spark, path, large_path)
        now, path = after, after_path
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    out = written(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    removed(spark, path)
    return out

"""Queries of resumable stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.operators.batches import Flow, Stage
from tradeloom.sources.shared import work_path
from tradeloom.sources.tables import table


def _stages(strict: bool) -> list[Stage]:
    """Read, parse and classify an order. A strict parser fails for some, which a later one reads; some can't be classified ever."""
    k = F.col("doc_id")
    return [
        Stage("read", lambda d: d.withColumn("text", F.concat_ws("|", "doc_id", "clerk", "amount"))),
        Stage("parse", lambda d: d.select("doc_id", F.split("text", r"\|")[2].cast("decimal(18,2)").alias("amount"), F.when((k % 7 == 0) & F.lit(strict), "no number").alias("error"))),
        Stage("classify", lambda d: d.select("doc_id", "amount", F.when(F.col("amount") > 150000, "large").otherwise("small").alias("kind"), F.when(k % 11 == 0, "unknown").alias("error"))),
    ]


def _orders(spark, d, changed: bool):
    o = table(spark, d, "orders")
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("clerk"), (F.when(F.col("o_orderkey") % 13 == 0, amount + 1).otherwise(amount) if changed else amount).cast("decimal(18,2)").alias("amount"))


def _ran(spark, d):
    """Three runs: one with a strict parser, one without, and one after some orders changed."""
    root = work_path(spark, "flow")
    Flow(spark, root, _stages(True)).run(_orders(spark, d, False)).count()
    Flow(spark, root, _stages(False)).run(_orders(spark, d, False)).count()
    flow = Flow(spark, root, _stages(False))
    return flow, flow.run(_orders(spark, d, True))


def batch_flow(spark, d):
    """The last stage's rows, and how often each order was attempted there."""
    flow, rows = _ran(spark, d)
    tries = flow.journal().groupBy("doc").agg(*[F.count_if(F.col("stage") == s).alias(s) for s in ("read", "parse", "classify")])
    return rows.join(tries, F.col("doc_id").cast("string") == F.col("doc")).select("doc_id", "amount", "kind", "read", "parse", "classify")


def batch_summary(spark, d):
    return _ran(spark, d)[0].summary()


QUERIES = {"batch_flow": batch_flow, "batch_summary": batch_summary}

SQL = {
    "batch_flow": """WITH o AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS amount FROM orders WHERE o_orderkey % 11 > 0)
        SELECT k AS doc_id, CAST(amount AS DECIMAL(18,2)) AS amount, CASE WHEN amount > 150000 THEN 'large' ELSE 'small' END AS kind, 1 + CAST(k % 13 = 0 AS INT) AS read, 1 + CAST(k % 7 = 0 AS INT) + CAST(k % 13 = 0 AS INT) AS parse, 1 + CAST(k % 13 = 0 AS INT) AS classify FROM o""",
    "batch_summary": """WITH o AS (SELECT o_orderkey AS k FROM orders)
        SELECT 'read' AS stage, count(*) + count(*) FILTER (k % 13 = 0) AS attempts, count(*) AS done, 0 AS failed FROM o
        UNION ALL SELECT 'parse', count(*) + count(*) FILTER (k % 7 = 0) + count(*) FILTER (k % 13 = 0), count(*), 0 FROM o
        UNION ALL SELECT 'classify', count(*) FILTER (k % 7 > 0) + count(*) FILTER (k % 11 = 0 AND k % 7 > 0) + count(*) FILTER (k % 7 = 0) + count(*) FILTER (k % 13 = 0 AND k % 11 > 0) + count(*) FILTER (k % 11 = 0), count(*) FILTER (k % 11 > 0), count(*) FILTER (k % 11 = 0) FROM o""",
}

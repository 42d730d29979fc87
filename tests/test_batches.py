from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tradeloom.operators.batches import Flow, PerfLog, Stage
from tradeloom.sources.shared import work_path


def docs(spark, n=10):
    return spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") * 10).alias("value"))


def failing(df):
    """Fails while it is computed, when part of its rows are written."""
    return df.withColumn("value", F.when(F.col("doc_id") == 9, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("value") + 1))


def test_a_failed_stage_is_resumed(spark):
    root = work_path(spark, "flow")
    first, bad, good, last = Stage("first", lambda d: d.withColumn("value", F.col("value") + 1)), Stage("second", failing), Stage("second", lambda d: d.withColumn("value", F.col("value") * 2)), Stage("third", lambda d: d)
    with pytest.raises(Exception, match="broken"):
        Flow(spark, root, [first, bad, last]).run(docs(spark)).collect()
    flow = Flow(spark, root, [first, bad, last])
    assert {r.stage: (r.attempts, r.done) for r in flow.summary().collect()} == {"first": (10, 10)}
    flow = Flow(spark, root, [first, good, last])
    assert sorted(map(tuple, flow.run(docs(spark)).collect())) == [(i, (i * 10 + 1) * 2) for i in range(10)]
    assert {r.stage: (r.attempts, r.done) for r in flow.summary().collect()} == {"first": (10, 10), "second": (10, 10), "third": (10, 10)}
    perf = {(r.name, r.failed): r for r in flow.perf.table().collect()}
    assert perf["second", None].rows == 10 and any(name == "second" and failed for name, failed in perf)
    assert sorted(r.rows for r in flow.perf.table().filter("name = 'first'").collect()) == [0, 10]  # the second run did nothing there
    again = Flow(spark, root, [first, good, last])
    assert again.run(docs(spark)).count() == 10 and {r.attempts for r in again.summary().collect()} == {10}


def test_rows_that_were_written_but_not_listed_dont_count(spark):
    root = work_path(spark, "flow")
    stages = [Stage("only", lambda d: d)]
    flow = Flow(spark, root, stages)
    flow.run(docs(spark, 3)).count()
    left = spark.createDataFrame([(7, 70, "7", 1, None, "lost")], "doc_id long, value long, __doc string, __input long, error string, __run string")
    left.select("doc_id", "value", "error", "__doc", "__input", "__run").write.parquet(f"{root}/stage=only/run=lost")
    assert sorted(r.doc_id for r in Flow(spark, root, stages).run(docs(spark, 3)).collect()) == [0, 1, 2]


def test_errors_stay_behind_and_are_tried_again(spark):
    root = work_path(spark, "flow")
    picky = Stage("pick", lambda d: d.withColumn("error", F.when(F.col("doc_id") % 3 == 0, F.lit("no"))))
    flow = Flow(spark, root, [picky, Stage("end", lambda d: d)])
    assert sorted(r.doc_id for r in flow.run(docs(spark)).collect()) == [1, 2, 4, 5, 7, 8]
    assert {r.stage: (r.attempts, r.done, r.failed) for r in flow.summary().collect()} == {"pick": (10, 6, 4), "end": (6, 6, 0)}
    Flow(spark, root, [picky, Stage("end", lambda d: d)]).run(docs(spark)).count()
    assert {r.stage: (r.attempts, r.done, r.failed) for r in flow.summary().collect()} == {"pick": (14, 6, 4), "end": (6, 6, 0)}
    newer = Flow(spark, root, [Stage("pick", lambda d: d, version=1), Stage("end", lambda d: d)])
    assert newer.run(docs(spark)).count() == 10
    assert {r.stage: (r.done, r.failed) for r in newer.summary().collect()} == {"pick": (10, 0), "end": (10, 0)}


def test_changed_and_new_documents(spark):
    root = work_path(spark, "flow")
    stages = [Stage("only", lambda d: d)]
    Flow(spark, root, stages).run(docs(spark, 4)).count()
    changed = docs(spark, 6).withColumn("value", F.when(F.col("doc_id") == 2, 99).otherwise(F.col("value")))
    flow = Flow(spark, root, stages)
    assert {r.doc_id: r.value for r in flow.run(changed).collect()} == {0: 0, 1: 10, 2: 99, 3: 30, 4: 40, 5: 50}
    assert flow.summary().first().attempts == 7
    assert Flow(spark, root, stages).run(changed.limit(0)).count() == 0
    with pytest.raises(ValueError):
        Flow(spark, root, stages * 2)


def test_phases_are_logged(spark):
    log = PerfLog(spark, work_path(spark, "perf"))
    with log.phase("count") as counted:
        counted(spark.range(50), F.col("id") % 5 == 0).write.format("noop").mode("overwrite").save()
    with pytest.raises(ZeroDivisionError), log.phase("broken"):
        1 / 0
    rows = {r.name: r for r in log.table().collect()}
    assert (rows["count"].rows, rows["count"].errors, rows["count"].failed) == (50, 10, None) and rows["count"].seconds > 0
    assert (rows["broken"].rows, rows["broken"].failed) == (0, "ZeroDivisionError") and len({r.run for r in rows.values()}) == 1

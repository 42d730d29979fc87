"""Stages that can be resumed, and a log of their rows and seconds.

A flow's folder has a table for each stage and a journal. A stage works on documents that the journal doesn't list as done with the same input. Its rows
are written under a run of their own first; the journal's rows, appended after them, make them count. What a run wrote before it failed isn't listed, so
it doesn't count and is done again. A stage is one job for all documents.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

JOURNAL = "stage string, doc string, input long, status string, error string, run string, at double"
PERF = "name string, run string, started_at double, seconds double, rows long, errors long, failed string"


class PerfLog:
    """Rows and seconds of named phases, appended to a table: a row a phase, also of one that fails (with the kind of error)."""

    def __init__(self, spark: SparkSession, path: str, run: str | None = None):
        self.spark, self.path, self.run = spark, path, run or uuid.uuid4().hex

    @contextmanager
    def phase(self, name: str) -> Iterator[Callable[..., DataFrame]]:
        """Gives a function that has a DataFrame's rows (and those of an ``error`` condition) counted while they are computed, by ``observe``; the
        phase must run one action on what it returns."""
        seen: list[Observation] = []
        began, wall, failed = time.monotonic(), time.time(), None

        def counted(df: DataFrame, error: Column | None = None) -> DataFrame:
            seen.append(Observation(f"{name}-{uuid.uuid4().hex}"))
            return df.observe(seen[-1], F.count(F.lit(1)).alias("rows"), (F.count_if(error) if error is not None else F.lit(0).cast("long")).alias("errors"))

        try:
            yield counted
        except BaseException as e:
            failed = type(e).__name__
            raise
        finally:
            sums = {"rows": 0, "errors": 0}
            for s in seen if failed is None else []:
                sums = {k: v + (s.get[k] or 0) for k, v in sums.items()}
            row = (name, self.run, wall, time.monotonic() - began, sums["rows"], sums["errors"], failed)
            self.spark.createDataFrame([row], PERF).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(PERF).parquet(self.path)


@dataclass(frozen=True)
class Stage:
    """``work`` maps rows with the key to rows with the key, at most one each, and may add ``error`` (text, null if all is well). ``version`` changes when
    the stage's rules do; its documents are done again then."""

    name: str
    work: Callable[[DataFrame], DataFrame]
    version: int = 0


class Flow:
    def __init__(self, spark: SparkSession, root: str, stages: list[Stage], key: str = "doc_id"):
        if len({s.name for s in stages}) < len(stages):
            raise ValueError("two stages of one name")
        self.spark, self.root, self.stages, self.key = spark, root.rstrip("/"), stages, key
        self.perf = PerfLog(spark, f"{self.root}/perf")
        spark.createDataFrame([], JOURNAL).write.mode("append").parquet(f"{self.root}/journal")

    def journal(self) -> DataFrame:
        return self.spark.read.schema(JOURNAL).parquet(f"{self.root}/journal")

    def _latest(self, stage: Stage) -> DataFrame:
        """The last attempt at each document."""
        return self.journal().filter(F.col("stage") == stage.name).groupBy("doc").agg(F.max(F.struct("at", "run", "input", "status")).alias("last")).select("doc", "last.*")

    def _done(self, stage: Stage, kind: DataType) -> DataFrame:
        """Documents that are done: the key in its own type, the input and the run."""
        return self._latest(stage).filter("status = 'success'").select(F.col("doc").cast(kind).alias(self.key), F.col("input").alias("__input"), F.col("run").alias("__run"))

    def _step(self, stage: Stage, docs: DataFrame) -> DataFrame:
        """Does what is left of a stage; gives the rows of all documents that it has done. Everything is joined by the key only; where earlier runs are
        listed, which documents they have done is written once, as the stage's work and the result both read it."""
        path = f"{self.root}/stage={stage.name}"
        run = self.perf.run + "-" + uuid.uuid4().hex[:8]
        todo = docs.withColumn("__input", F.xxhash64(F.lit(stage.version), F.lit(stage.name), *[F.col(c) for c in docs.columns]))
        before = None
        if not self.journal().filter(F.col("stage") == stage.name).isEmpty():
            done = self._done(stage, docs.schema[self.key].dataType).withColumnRenamed("__input", "__was")
            known = todo.join(done, self.key, "left").withColumn("__run", F.when(F.col("__was") == F.col("__input"), F.col("__run"))).drop("__was")
            known.write.parquet(f"{self.root}/known={stage.name}/run={run}")
            known = self.spark.read.schema(known.schema).parquet(f"{self.root}/known={stage.name}/run={run}")
            todo, before = known.filter("__run IS NULL").drop("__run"), known.filter("__run IS NOT NULL").select(self.key, "__input", "__run")
        with self.perf.phase(stage.name) as counted:
            out = stage.work(todo.drop("__input"))
            out = out if "error" in out.columns else out.withColumn("error", F.lit(None).cast("string"))
            # one row a document, whatever the stage makes, with the input that it stands for
            made = out.join(todo.select(self.key, "__input"), self.key).select(*out.columns, F.col(self.key).cast("string").alias("__doc"), "__input", F.lit(run).alias("__run"))
            counted(made, F.col("error").isNotNull()).write.parquet(f"{path}/run={run}")
        wrote = self.spark.read.schema(made.schema).parquet(f"{path}/run={run}")
        status = F.when(F.col("error").isNull(), "success").otherwise("error")
        listed = wrote.select(F.lit(stage.name).alias("stage"), F.col("__doc").alias("doc"), F.col("__input").alias("input"), status.alias("status"), "error", F.lit(run).alias("run"), F.lit(time.time()).alias("at"))
        listed.write.mode("append").parquet(f"{self.root}/journal")
        rows = wrote.filter(F.col("error").isNull())
        if before is not None:
            every = self.spark.read.schema(made.schema).option("recursiveFileLookup", "true").parquet(path).filter(F.col("__run") != run)
            rows = rows.unionByName(every.join(before, [self.key, "__input", "__run"]).select(*made.columns))
        return rows.drop("__doc", "__input", "__run", "error")

    def run(self, docs: DataFrame) -> DataFrame:
        """The last stage's rows of all documents that got so far, in this run or an earlier one."""
        for stage in self.stages:
            docs = self._step(stage, docs)
        return docs

    def summary(self) -> DataFrame:
        """stage, and how many documents are done, failed at the last attempt, and were attempted in all."""
        each = self.journal().groupBy("stage", "doc").agg(F.count("*").alias("tries"), F.max(F.struct("at", "run", "status"))["status"].alias("status"))
        return each.groupBy("stage").agg(F.sum("tries").alias("attempts"), F.count_if(F.col("status") == "success").alias("done"), F.count_if(F.col("status") == "error").alias("failed"))

"""Streams of messages and file events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import TimestampNTZType

from tradeloom.sources.shared import work_path


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files ``name.parquet`` of a folder as a stream, with the schema of what is there; times without a zone, which watermarks
    don't take, are read in the session's zone."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if isinstance(f.dataType, TimestampNTZType)})


def gathered(rows: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is available now, into the shared folder, and returns what it gave. Every batch has a path of its
    own and is written again in place after a failure; in complete mode the last batch counts."""
    spark = rows.sparkSession
    out = work_path(spark, "stream")
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/b{number:06d}")
        last.append(number)

    query = rows.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{out}/state").foreachBatch(keep).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], rows.schema)
    return spark.read.schema(rows.schema).parquet(f"{out}/rows/" + ("b*" if mode == "append" else f"b{max(last):06d}"))


def first_seen(messages: DataFrame, ident: str, at: str, within: str = "14 days") -> DataFrame:
    """Messages whose id was not seen within the delay."""
    return messages.withWatermark(at, within).dropDuplicatesWithinWatermark([ident])


def counted(messages: DataFrame, at: str, every: str, *by: str, late: str = "1 day") -> DataFrame:
    """Rows and their values in windows of a fixed length. A window is given once, when the latest time is ``late`` beyond its end, and its
    state is dropped then."""
    w = messages.withWatermark(at, late).groupBy(F.window(at, every), *by).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(18,2)").alias("value"))
    return w.select(F.col("window.start").alias("start"), *by, "n", "value")


def sessions(messages: DataFrame, at: str, gap: str, by: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each ``by``, ended by a ``gap``; given and dropped as in ``counted``."""
    w = messages.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("start"), by, "n")


def paired(a: DataFrame, b: DataFrame, ident: str, at: str, by: str, within: str = "14 days") -> DataFrame:
    """Pairs of messages of both streams by the same client, the second at most ``within`` before the first."""
    left = a.select(F.col(ident).alias("message_id"), F.col(by).alias("client"), F.col(at).alias("at")).withWatermark("at", within)
    right = b.select(F.col(ident).alias("other_id"), F.col(by).alias("other_client"), F.col(at).alias("other_at")).withWatermark("other_at", within)
    near = F.expr(f"client = other_client AND other_at < at AND other_at > at - INTERVAL {within}")
    return left.join(right, near).select("message_id", "other_id")


def settled(events: DataFrame, at: str, by: str, what: str, ident: str, quiet: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The last event of each path in each window: bursts are handled once; given and dropped as in ``counted``."""
    w = events.withWatermark(at, late).groupBy(F.window(at, quiet), by).agg(F.max_by(F.struct(what, ident), F.struct(at, ident)).alias("last"), F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), by, F.col(f"last.{what}").alias(what), "n")


def retried(events: DataFrame, by: str, ident: str, at: str, most: int = 3, forget_days: int = 30, late: str = "10 seconds") -> DataFrame:
    """Failed messages that are tried again: the first ``most`` of each client, with the attempt. The count is kept as state, and forgotten when a client
    has had no message for ``forget_days`` (event time): such a client begins anew."""
    forget = forget_days * 86_400_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, seen = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            ids: list[int] = []
        else:
            rows = [(int(i), t.value // 1_000_000) for f in frames for i, t in zip(f[ident], f[at], strict=True)]
            ids, seen = sorted(i for i, _ in rows)[: max(0, most - done)], max([seen, *(t for _, t in rows)])
            state.update((done + len(ids), seen))
            state.setTimeoutTimestamp(max(seen + forget, state.getCurrentWatermarkMs() + 1))
        made = {by: [key[0]] * len(ids), ident: ids, "attempt": list(range(done + 1, done + len(ids) + 1))}
        yield pd.DataFrame({c: pd.Series(v, dtype="int64") for c, v in made.items()})

    kept = events.withWatermark(at, late).groupBy(by)
    return kept.applyInPandasWithState(step, f"{by} long, {ident} long, attempt int", "done int, seen long", "append", GroupStateTimeout.EventTimeTimeout)

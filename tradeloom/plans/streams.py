"""Queries of streams: the events table is read as a stream, all that is available now."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.streaming import events as S


def _zoneless(rows, *columns):
    """Times without a zone, as in the tables."""
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def dedup(spark, d):
    """Messages of one user and day are one: each but the first of them is a repetition."""
    messages = S.stream(spark, d, "events").select(F.concat_ws("/", "user_id", F.to_date("ts")).alias("message_id"), "user_id", F.date_trunc("day", "ts").alias("ts"))
    return _zoneless(S.gathered(S.first_seen(messages, "message_id", "ts")), "ts")


def tumbling(spark, d):
    return _zoneless(S.gathered(S.counted(S.stream(spark, d, "events"), "ts", "1 day", "event_type")), "start")


def sessions(spark, d):
    return _zoneless(S.gathered(S.sessions(S.stream(spark, d, "events"), "ts", "30 minutes", "user_id")), "start")


def pairing(spark, d):
    kind = lambda k: S.stream(spark, d, "events").filter(F.col("event_type") == k)
    return S.gathered(S.paired(kind("purchase"), kind("signup"), "event_id", "ts", "user_id"))


def debounce(spark, d):
    return _zoneless(S.gathered(S.settled(S.stream(spark, d, "events"), "ts", "user_id", "event_type", "event_id")), "start")


def retries(spark, d):
    return S.gathered(S.retried(S.stream(spark, d, "events").filter("event_type = 'error'").select("user_id", "event_id", "ts"), "user_id", "event_id", "ts"))


QUERIES = {"stream_dedup": dedup, "stream_tumbling": tumbling, "stream_session": sessions, "stream_pairing": pairing, "stream_debounce": debounce, "stream_retry": retries}

SQL = {
    "stream_dedup": "SELECT DISTINCT user_id || '/' || strftime(ts, '%Y-%m-%d') AS message_id, user_id, date_trunc('day', ts) AS ts FROM events",
    "stream_tumbling": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS value FROM events GROUP BY 1, 2 HAVING start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY",
    "stream_session": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "stream_pairing": "SELECT a.event_id AS message_id, b.event_id AS other_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts < a.ts AND b.ts > a.ts - INTERVAL 14 DAY WHERE a.event_type = 'purchase' AND b.event_type = 'signup'",
    "stream_debounce": """WITH w AS (SELECT *, make_timestamp((epoch_us(ts) // 300000) * 300000) AS start FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id, start ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id, start) AS n FROM w) SELECT start, user_id, event_type, n FROM r WHERE r = 1 AND start + INTERVAL 300 MILLISECOND <= (SELECT max(ts) FROM events) - INTERVAL 10 SECOND""",
    "stream_retry": "SELECT user_id, event_id, CAST(r AS INT) AS attempt FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type = 'error') WHERE r <= 3",
}

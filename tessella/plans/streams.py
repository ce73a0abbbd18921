"""Streaming queries, drained through a file sink and held against the batch answer."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.registry import query
from tessella.sources.scratch import scratch
from tessella.streaming import UpsertTable, drained, first_of_window, replayed, running_totals, session_counts, sliding_counts, table_stream, tumbling_counts, visit_starts, with_event_time
from tessella.tables import table

#: Windows that end by the watermark, which is the latest event less the delay, are final.
_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_event_time(table_stream(spark, sf_dir, "events"), "ts", "1 hour")


def _ntz(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "stream_tumbling",
    f"""
    SELECT start, event_type, n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    WHERE start + INTERVAL 6 HOUR <= {_CLOSED}
    """,
)
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(drained(tumbling_counts(_events(spark, sf_dir), "ts", "6 hours", "event_type"), "tumbling"))


@query(
    "stream_sliding",
    f"""
    SELECT start, n FROM (SELECT start, count(*) AS n FROM (
      SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR * i AS start FROM events, range(0, 2) t(i)) GROUP BY start)
    WHERE start + INTERVAL 12 HOUR <= {_CLOSED}
    """,
)
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(drained(sliding_counts(_events(spark, sf_dir), "ts", "12 hours", "6 hours"), "sliding"))


@query(
    "stream_sessions",
    f"""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}
    """,
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(drained(session_counts(_events(spark, sf_dir), "ts", "30 minutes", "user_id"), "sessions"))


@query("stream_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and types of events: each once a day by the stream, whose state is that of the days that are open, and once in all by what reads its sink."""
    stream = with_event_time(replayed(list(_halves(spark, sf_dir)), "distinct-events"), "ts", "1 hour")
    return drained(first_of_window(stream, "ts", "1 day", "user_id", "event_type"), "distinct").select("user_id", "event_type").distinct()


@query(
    "stream_join",
    """
    SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id
    AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR WHERE v.event_type = 'view' AND p.event_type = 'purchase'
    """,
)
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with the purchases of the hour after; the watermarks and the time bound let old rows go from the state."""
    v = _events(spark, sf_dir).where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("u"), F.col("ts").alias("t"))
    p = _events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", "ts")
    met = v.join(p, F.expr("u = user_id and ts >= t and ts <= t + interval 1 hour"))
    return drained(met.select("view_id", "purchase_id"), "stream-join")


@query("stream_state", "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals in keyed state, which users leave who stay away for two days; the totals of a user are the last of each stay, added up."""
    halves = [half.select("user_id", "value", "ts") for half in _halves(spark, sf_dir)]
    days = [x for half in halves for x in (half.where("day(ts) % 15 < 8"), half.where("day(ts) % 15 >= 8"))]
    stream = with_event_time(replayed(days, "totals"), "ts", "1 hour")
    rows = drained(running_totals(stream, "user_id", "value", "ts", "2 days"), "state")
    stays = rows.groupBy("user_id", "since").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))
    return stays.groupBy("user_id").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The events before and from the middle of the month on."""
    events = table(spark, sf_dir, "events")
    return events.where("ts < timestamp_ntz '2024-01-15 00:00:00'"), events.where("ts >= timestamp_ntz '2024-01-15 00:00:00'")


@query(
    "stream_late_data",
    f"""
    SELECT start, n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM events
      WHERE event_type <> 'error' OR ts >= TIMESTAMP '2024-01-15' GROUP BY 1) WHERE start + INTERVAL 6 HOUR <= {_CLOSED}
    """,
)
def stream_late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the first half arrive after all else: their windows are closed by then, so they don't count.

    What is late in a batch is told by the watermark that held when the batch before it
    began, which knows the events up to the batch before that one. So the second half comes
    in two batches: the first of them moves the watermark past all windows of the first
    half, and the second lets the errors' batch know.
    """
    first, second = _halves(spark, sf_dir)
    day, rest = second.where("ts < timestamp_ntz '2024-01-16 00:00:00'"), second.where("ts >= timestamp_ntz '2024-01-16 00:00:00'")
    stream = replayed([first.where("event_type <> 'error'"), day, rest, first.where("event_type = 'error'")], "late")
    return _ntz(drained(tumbling_counts(with_event_time(stream, "ts", "1 hour"), "ts", "6 hours"), "late-counts"))


@query("stream_distinct_within_watermark", "SELECT event_id, event_type FROM events")
def stream_distinct_within_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice, in one batch or in two; ids are held as state until the watermark has passed them."""
    first, second = _halves(spark, sf_dir)
    errors = F.col("event_type") == "error"
    stream = replayed([first.union(first.where(errors)), first.where(~errors).union(second), second], "twice")
    once = with_event_time(stream, "ts", "40 days").dropDuplicatesWithinWatermark(["event_id"])
    return drained(once.select("event_id", "event_type"), "once")


@query(
    "stream_visits",
    """
    SELECT user_id, ts AS start FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    WHERE before IS NULL OR ts - before >= INTERVAL 12 HOUR
    """,
)
def stream_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of visits, by keyed state with timers, over several batches."""
    stream = with_event_time(replayed([x.select("user_id", "ts") for x in _halves(spark, sf_dir)], "visits"), "ts", "1 hour")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # timers need it
    try:
        return _ntz(drained(visit_starts(stream, "user_id", "ts", pd.Timedelta(hours=12)), "visit-starts"))
    finally:
        spark.conf.set(name, before)


@query(
    "stream_outer_join",
    """
    WITH v AS (SELECT * FROM events WHERE event_type = 'view'), p AS (SELECT * FROM events WHERE event_type = 'purchase')
    SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM v LEFT JOIN p ON v.user_id = p.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR
    WHERE p.event_id IS NOT NULL OR v.ts + INTERVAL 1 HOUR < (SELECT least((SELECT max(ts) FROM v), (SELECT max(ts) FROM p)) - INTERVAL 1 HOUR)
    """,
)
def stream_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with the purchases of the hour after, and views without any once the watermark says that none can come; over several batches."""
    parts = [part for half in _halves(spark, sf_dir) for part in (half.where("day(ts) % 15 < 7"), half.where("day(ts) % 15 >= 7"))]
    bring = lambda kind: with_event_time(replayed([x.where(F.col("event_type") == kind) for x in parts], kind), "ts", "1 hour")
    v = bring("view").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("u"), F.col("ts").alias("t"))
    p = bring("purchase").select(F.col("event_id").alias("purchase_id"), "user_id", "ts")
    met = v.join(p, F.expr("u = user_id and ts >= t and ts <= t + interval 1 hour"), "left")
    return drained(met.select("view_id", "purchase_id"), "outer-join")


@query(
    "stream_upserts",
    """
    SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events)
    WHERE k = 1 AND event_type <> 'signup'
    """,
)
def stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, kept up by a stream whose job dies after it has written a batch and before that is committed; a signup deletes its user."""
    first, second = _halves(spark, sf_dir)
    stream = replayed([first, second.where("event_id % 2 = 0"), second.where("event_id % 2 = 1")], "upserts").withColumn("gone", F.col("event_type") == "signup")
    held = UpsertTable(spark, scratch(spark, "latest-events"), "user_id long, event_id long, event_type string, value double", ["user_id"], "event_id")
    state, died = scratch(spark, "upserts-state"), []

    def put(batch: DataFrame, number: int) -> None:
        held.write(batch, number)
        if number == 1 and not died:
            died.append(number)
            raise RuntimeError("the job dies here")

    for _ in range(2):
        job = stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
        try:
            job.awaitTermination()
        except StreamingQueryException:
            continue
    held.compact(1)
    return held.read()

"""User-defined functions, in Arrow batches, and file formats."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.aggregates import exact_sum, longest_rise, regression
from tessella.operators.tables import CHANGES
from tessella.operators.temporal import as_of_join
from tessella.plans.registry import query
from tessella.shipping import ship
from tessella.sources import buckets_for, read, write, write_bucketed
from tessella.sources.scratch import remove, scratch, written
from tessella.sources.segments import SegmentSource, segment_rows
from tessella.streaming import drained, tumbling_counts, with_event_time
from tessella.tables import table


@query("udf_vectorized", "SELECT p_partkey, round(p_retailprice * 1.19, 4) AS gross FROM part")
def udf_vectorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def gross(net: pd.Series) -> pd.Series:
        return net * 1.19

    return table(spark, sf_dir, "part").select("p_partkey", F.round(gross("p_retailprice"), 4).alias("gross"))


@query("udf_grouped_aggregate", "SELECT c_mktsegment, round(max(c_acctbal) - min(c_acctbal), 2) AS span FROM customer GROUP BY c_mktsegment")
def udf_grouped_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def span(x: pd.Series) -> float:
        return float(x.max() - x.min())

    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.round(span("c_acctbal"), 2).alias("span"))


@query(
    "udf_cogroup",
    """
    SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers
    FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey) OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)
    """,
)
def udf_cogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n_nationkey": [key[0]], "customers": [len(a)], "suppliers": [len(b)]})

    a = table(spark, sf_dir, "customer").select("c_nationkey").groupBy("c_nationkey")
    b = table(spark, sf_dir, "supplier").select("s_nationkey").groupBy("s_nationkey")
    return a.cogroup(b).applyInPandas(count, "n_nationkey int, customers long, suppliers long")


@query("udtf_lateral", "SELECT n_nationkey, i::BIGINT AS i, substring(n_name, i, 1) AS letter FROM nation, LATERAL range(1, length(n_name) + 1) t(i)")
def udtf_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    class Letters:
        def eval(self, text: str):
            yield from enumerate(text, 1)

    spark.udtf.register("letters_of", F.udtf(Letters, returnType="i: bigint, letter: string"))
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, i, letter FROM nation, LATERAL letters_of(n_name)")


@query("formats_round_trip", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal, 4::BIGINT AS n_formats FROM supplier")
def formats_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written in every format and read back: each row comes four times, and once in the result."""
    rows = table(spark, sf_dir, "supplier")
    back = None
    for fmt in ("parquet", "orc", "json", "csv"):
        path = scratch(spark, f"suppliers-{fmt}")
        write(rows, path, fmt)
        own = read(spark, path, fmt, rows.schema)
        back = own if back is None else back.unionByName(own)
    return back.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n_formats"))


@query("partitioned_write", "SELECT o_orderpriority, o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def partitioned_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table partitioned by a column; the filter reads one partition's files."""
    path = scratch(spark, "orders-by-status")
    write(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey"), path, partition_by=["o_orderstatus"])
    return spark.read.parquet(path).where("o_orderstatus = 'P'").select("o_orderpriority", "o_orderkey")


@query("bucketed_join", "SELECT o_orderpriority, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables bucketed by their key when they are written, in the shared folder: the join shuffles neither. Both have as many buckets as the larger one asks for."""
    sides = {"orders": ("o_orderkey", "o_orderpriority"), "lineitem": ("l_orderkey", "l_quantity")}
    rows = {name: table(spark, sf_dir, name).select(*columns) for name, columns in sides.items()}
    buckets, names = buckets_for(max(df.count() for df in rows.values())), []
    for name, df in rows.items():
        names.append(f"tessella_{name}_{uuid.uuid4().hex}")
        path = scratch(spark, names[-1])
        write_bucketed(df, names[-1], buckets, [sides[name][0]], path)
        atexit.register(remove, spark, path)
        atexit.register(_drop, spark, names[-1])
    orders, lines = map(spark.table, names)
    met = orders.join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    return met.groupBy("o_orderpriority").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))


def _drop(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@query(
    "udf_longest_rise",
    """
    WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice > lag(o_totalprice) OVER w THEN 0 ELSE 1 END AS fresh FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    g AS (SELECT o_custkey, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS k FROM r)
    SELECT o_custkey, max(n)::BIGINT AS longest FROM (SELECT o_custkey, k, count(*) AS n FROM g GROUP BY o_custkey, k) GROUP BY o_custkey
    """,
)
def udf_longest_rise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of rising order prices of each customer: an aggregate that depends on the order of rows, in states that ranges of them merge to."""
    return longest_rise(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "o_totalprice")


@query(
    "udf_nearest_event",
    """
    SELECT e.event_id, min(abs(date_diff('second', e.ts, p.ts)))::BIGINT AS seconds FROM events e JOIN events p ON e.user_id = p.user_id
    WHERE e.event_type = 'error' AND p.event_type = 'purchase' GROUP BY e.event_id
    """,
)
def udf_nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error the purchase of its user that is nearest in time, before or after: one as-of join each way, of which no user's rows meet in one task."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    errors, purchases = (events.where(F.col("event_type") == x).select("event_id", "user_id", "at", (-F.col("at")).alias("back")) for x in ("error", "purchase"))
    found = as_of_join(errors, purchases.select("user_id", "at"), ["user_id"], "at", [], "before_")
    found = as_of_join(found, purchases.select("user_id", "back"), ["user_id"], "back", [], "after_")
    seconds = F.least(F.col("at") - F.col("before_at"), F.col("back") - F.col("after_back"))
    return found.where(seconds.isNotNull()).select("event_id", seconds.alias("seconds"))


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@contextlib.contextmanager
def _segments(spark: SparkSession, sf_dir: str, pieces: int) -> Iterator[str]:
    """A folder of the events in order of time, a segment a file, with the data source ready to read it."""
    ship(spark)
    spark.dataSource.register(SegmentSource)
    path = scratch(spark, "segments")
    table(spark, sf_dir, "events").repartitionByRange(pieces, "ts").sortWithinPartitions("ts").write.parquet(path)
    before = spark.conf.get(PUSHDOWN)
    spark.conf.set(PUSHDOWN, "true")
    try:
        yield path
    finally:
        spark.conf.set(PUSHDOWN, before)


@query(
    "segment_source",
    """
    SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, TRUE AS fewer_segments FROM events
    WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-15' AND event_type <> 'view' GROUP BY event_type
    """,
)
def segment_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five days through a Python data source: of 24 segments in order of time, the filter leaves few; the source makes no tasks for the others."""
    with _segments(spark, sf_dir, 24) as path:
        days = segment_rows(spark, path, "ts >= timestamp_ntz '2024-01-10 00:00:00' and ts < timestamp_ntz '2024-01-15 00:00:00' and event_type <> 'view'")
        fewer = days.rdd.getNumPartitions() <= 8 and segment_rows(spark, path).rdd.getNumPartitions() >= 16
        return written(days.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")), "five-days").withColumn("fewer_segments", F.lit(fewer))


@query(
    "segment_stream",
    """
    SELECT start, n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM events GROUP BY 1)
    WHERE start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
    """,
)
def segment_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same source as a stream, some segments a batch, which counts windows as the watermark passes them."""
    with _segments(spark, sf_dir, 8) as path:
        stream = spark.readStream.format("segments").option("segmentsPerBatch", 3).load(path)
        counts = tumbling_counts(with_event_time(stream, "ts", "1 hour"), "ts", "6 hours")
        return drained(counts, "segment-counts", ends=False).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "udaf_regression",
    """
    WITH m AS (SELECT l_linestatus, avg(l_quantity) AS mx, avg(l_tax) AS mz, avg(l_extendedprice) AS my FROM lineitem GROUP BY l_linestatus),
    s AS (SELECT l.l_linestatus, any_value(mx) AS mx, any_value(mz) AS mz, any_value(my) AS my, sum((l_quantity - mx) * (l_quantity - mx)) AS xx, sum((l_tax - mz) * (l_tax - mz)) AS zz,
      sum((l_quantity - mx) * (l_tax - mz)) AS xz, sum((l_quantity - mx) * (l_extendedprice - my)) AS xy, sum((l_tax - mz) * (l_extendedprice - my)) AS zy
      FROM lineitem l JOIN m ON l.l_linestatus = m.l_linestatus GROUP BY l.l_linestatus),
    b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM s)
    SELECT l_linestatus, round(my - bx * mx - bz * mz, 3) AS intercept, round(bx, 4) AS per_quantity, round(bz, 3) AS per_tax FROM b
    """,
)
def udaf_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices explained by two columns at once: an aggregate of one's own, in partial states, which built-ins have for one column only."""
    rows = regression(table(spark, sf_dir, "lineitem"), ["l_linestatus"], ["l_quantity", "l_tax"], "l_extendedprice")
    c = F.col("coefficients")
    return rows.select("l_linestatus", F.round(c[0], 3).alias("intercept"), F.round(c[1], 4).alias("per_quantity"), F.round(c[2], 3).alias("per_tax"))


@query(
    "udaf_exact_sum",
    """
    SELECT CASE WHEN event_id % 10 = 0 THEN event_type ELSE 'most' END AS kind, round(sum(value::DECIMAL(38, 12))::DOUBLE, 6) AS total FROM events GROUP BY 1
    """,
)
def udaf_exact_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of doubles that don't depend on the order of rows, of keys one of which has nine tenths of them."""
    kind = F.when(F.col("event_id") % 10 == 0, F.col("event_type")).otherwise("most").alias("kind")
    rows = table(spark, sf_dir, "events").select(kind, "value")
    return exact_sum(rows, ["kind"], "value", "total").withColumn("total", F.round("total", 6))


@query(
    "udtf_changes",
    """
    WITH r AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR lag(event_id) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM r)
    SELECT user_id, min_by(event_id, (ts, event_id)) AS event_id, min(ts) AS ts, any_value(event_type) AS event_type, count(*) AS run_rows FROM g GROUP BY user_id, k
    """,
)
def udtf_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one kind of event of each user, by a table function that takes any table: its columns come out as they went in, and a count."""
    ship(spark)
    spark.udtf.register("changes", CHANGES)
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return spark.sql("SELECT * FROM changes(TABLE({events}) PARTITION BY (user_id) ORDER BY (ts, event_id), 'event_type')", events=events)

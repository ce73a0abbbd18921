"""Scans, filters, joins, aggregation, set operations, sorts and subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import as_long
from tessella.operators.fixpoint import reachable
from tessella.operators.intervals import overlap_counts, overlap_join
from tessella.operators.quantiles import exact_quantiles
from tessella.operators.temporal import dominance_counts, range_join, salted_sum, top_per_group
from tessella.plans.registry import query
from tessella.sources.scratch import written
from tessella.tables import register_views, table


def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query(
    "pricing_summary",
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
           round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02'
    GROUP BY l_returnflag, l_linestatus
    """,
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, projection and hash aggregation over the largest table."""
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum(_revenue()), 2).alias("revenue"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count(F.lit(1)).alias("n"),
        )
    )


@query(
    "filter_project",
    """
    SELECT c_custkey, c_name, c_mktsegment FROM customer
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 0 AND 5000 AND c_name LIKE '%1%'
    """,
)
def filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IN, BETWEEN and LIKE, pushed to the scan as far as parquet filters go."""
    c = table(spark, sf_dir, "customer")
    kept = F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_acctbal").between(0, 5000) & F.col("c_name").like("%1%")
    return c.where(kept).select("c_custkey", "c_name", "c_mktsegment")


@query(
    "left_outer_join",
    "SELECT o_orderkey, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
)
def left_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the number of their line items, 0 included: line items are counted before the join."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query(
    "full_outer_join",
    """
    WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 3000), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 250000)
    SELECT a.k AS customer, b.k AS buyer FROM a FULL JOIN b ON a.k = b.k
    """,
)
def full_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal < 3000").select(F.col("c_custkey").alias("customer"))
    b = table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("buyer")).distinct()
    return a.join(b, F.col("customer") == F.col("buyer"), "full")


@query(
    "semi_join",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)",
)
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_orderpriority")


@query("anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT IN over a column without nulls, as the anti join that Spark can shuffle; its null-aware form needs a broadcast."""
    buyers = table(spark, sf_dir, "orders").where("o_custkey is not null and o_totalprice > 400000").select("o_custkey")
    return table(spark, sf_dir, "customer").join(buyers, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(
    "inequality_join",
    """
    SELECT p.p_partkey, count(*) AS n FROM part p JOIN part q ON p.p_brand = q.p_brand AND p.p_retailprice < q.p_retailprice AND p.p_size > q.p_size
    GROUP BY p.p_partkey
    """,
)
def inequality_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inequalities beside an equality, counted without making the pairs."""
    return dominance_counts(table(spark, sf_dir, "part"), ["p_brand"], "p_partkey", "p_retailprice", "p_size", "n")


@query(
    "price_band_join",
    """
    SELECT band, count(*) AS n FROM orders JOIN (SELECT i AS band, i * 25000.0 AS low, (i + 1) * 25000.0 AS high FROM range(0, 20) t(i)) b
    ON o_totalprice >= low AND o_totalprice < high GROUP BY band
    """,
)
def price_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join by cells."""
    bands = spark.range(20).select(F.col("id").alias("band"), (F.col("id") * 25000.0).alias("low"), ((F.col("id") + 1) * 25000.0).alias("high"))
    return range_join(table(spark, sf_dir, "orders").select("o_totalprice"), bands, "o_totalprice", "low", "high", 25000.0).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query("cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of fixed size."""
    return table(spark, sf_dir, "region").select("r_name").crossJoin(table(spark, sf_dir, "nation").select("n_name"))


@query(
    "lateral_top_orders",
    """
    SELECT c_custkey, o_orderkey, o_totalprice FROM customer,
    LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t
    """,
)
def lateral_top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two largest orders of each customer: top n per group, then the join."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    best = top_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)
    return table(spark, sf_dir, "customer").join(best, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query(
    "six_way_join",
    """
    SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
    JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey
    WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY n_name
    """,
)
def six_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two tables of fixed size are broadcast; Spark chooses for the others by their sizes."""
    t = lambda name: table(spark, sf_dir, name)
    nations = t("nation").join(F.broadcast(t("region").where(F.col("r_name").isin("ASIA", "EUROPE"))), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = t("customer").join(F.broadcast(nations.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t("orders").select("o_orderkey", "o_custkey").join(customers.select("c_custkey", "c_nationkey", "n_name"), F.col("o_custkey") == F.col("c_custkey"))
    lines = t("lineitem").select("l_orderkey", "l_suppkey", _revenue().alias("r")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    met = lines.join(t("supplier"), (F.col("s_suppkey") == F.col("l_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return met.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@query(
    "join_strategies",
    "SELECT o_orderpriority, count(*) AS n_merge, count(*) AS n_hash, count(*) AS n_broadcast FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderpriority",
)
def join_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One join by three physical strategies."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey")
    on = F.col("o_custkey") == F.col("c_custkey")
    counted = [
        orders.join(customers.hint(hint), on).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias(name))
        for hint, name in (("merge", "n_merge"), ("shuffle_hash", "n_hash"), ("broadcast", "n_broadcast"))
    ]
    return counted[0].join(counted[1], "o_orderpriority").join(counted[2], "o_orderpriority")


@query(
    "distinct_filter_having",
    """
    SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_priorities, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_final, count(*) AS n
    FROM orders GROUP BY o_custkey HAVING count(*) > 12
    """,
)
def distinct_filter_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count_distinct("o_orderpriority").alias("n_priorities"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"), F.count(F.lit(1)).alias("n")
    )
    return grouped.where("n > 12")


@query(
    "rollup_levels",
    """
    SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS g_flag, CAST(grouping(l_linestatus) AS BIGINT) AS g_status, count(*) AS n
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
    """,
)
def rollup_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(
        as_long(F.grouping("l_returnflag")).alias("g_flag"), as_long(F.grouping("l_linestatus")).alias("g_status"), F.count(F.lit(1)).alias("n")
    )


@query("cube_levels", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_GROUPING_SETS = """
    SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer
    GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())
"""


@query("grouping_sets", _GROUPING_SETS)
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, "customer")
    return spark.sql(_GROUPING_SETS)


@query(
    "exact_percentiles",
    """
    SELECT c_mktsegment, round(median(c_acctbal), 4) AS middle, round(quantile_cont(c_acctbal, 0.9), 4) AS upper FROM customer GROUP BY c_mktsegment
    """,
)
def exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By cells and ranks: the built-in `percentile` would keep all values of a segment in one task."""
    found = exact_quantiles(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", {"middle": 0.5, "upper": 0.9})
    return found.select("c_mktsegment", F.round("middle", 4).alias("middle"), F.round("upper", 4).alias("upper"))


@query("builtin_percentiles", "SELECT o_custkey, round(median(o_totalprice), 4) AS middle, round(quantile_cont(o_totalprice, 0.9), 4) AS upper FROM orders GROUP BY o_custkey")
def builtin_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a customer's orders are small: the built-in aggregates do."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.round(F.median("o_totalprice"), 4).alias("middle"), F.round(F.percentile("o_totalprice", F.lit(0.9)), 4).alias("upper")
    )


@query(
    "spread_and_correlation",
    """
    SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS deviation, round(var_pop(l_quantity), 6) AS variance,
           round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem GROUP BY l_returnflag
    """,
)
def spread_and_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.stddev_samp("l_quantity"), 6).alias("deviation"), F.round(F.var_pop("l_quantity"), 6).alias("variance"),
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("correlation"),
    )


@query("largest_order", "SELECT o_custkey, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def largest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"))


@query("approximate_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n_exact, true AS is_near FROM lineitem GROUP BY l_returnflag")
def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch's count is within a tenth of the exact one."""
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n_exact"), F.approx_count_distinct("l_partkey", 0.02).alias("n_near"))
    return grouped.select("l_returnflag", "n_exact", (F.abs(F.col("n_near") - F.col("n_exact")) <= 0.1 * F.col("n_exact")).alias("is_near"))


@query(
    "pivot_status",
    """
    SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p
    FROM orders GROUP BY o_orderpriority
    """,
)
def pivot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("o_orderpriority", *[F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query(
    "unpivot_part",
    "SELECT p_partkey, 'p_size' AS name, CAST(p_size AS DOUBLE) AS amount FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part",
)
def unpivot_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return rows.unpivot("p_partkey", ["p_size", "p_retailprice"], "name", "amount")


@query("skewed_sum", "SELECT event_type, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def skewed_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum by few keys in two salted steps."""
    sums = salted_sum(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value", 16, "total")
    return sums.withColumn("total", F.round("total", 2))


@query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("top_k_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def top_k_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20)


@query("nulls_last_order", "SELECT x FROM (SELECT nullif(n_regionkey, 2) AS x FROM nation) ORDER BY x DESC NULLS LAST LIMIT 12")
def nulls_last_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.nullif("n_regionkey", F.lit(2)).alias("x")).orderBy(F.desc_nulls_last("x")).limit(12)


@query(
    "scalar_subquery",
    "SELECT o_orderkey FROM orders o WHERE o_totalprice > 1.5 * (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
)
def scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated average, decorrelated into one aggregation and a join."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    mean = orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean"))
    return orders.join(mean, "o_custkey").where("o_totalprice > 1.5 * mean").select("o_orderkey")


_RECURSIVE = """
    WITH RECURSIVE said(conv_id, turn, chars) AS (
      SELECT conv_id, turn, CAST(length(text) AS BIGINT) FROM conversations WHERE turn = 0
      UNION ALL SELECT c.conv_id, c.turn, said.chars + CAST(length(c.text) AS BIGINT) FROM said JOIN conversations c ON c.conv_id = said.conv_id AND c.turn = said.turn + 1)
    SELECT conv_id, turn, chars FROM said
"""


@query("recursive_cte", _RECURSIVE)
def recursive_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations followed turn by turn, in SQL, whose engine bounds the rounds and rows of a recursion; `reachable_nodes` has one without such bounds."""
    register_views(spark, sf_dir, "conversations")
    return spark.sql(_RECURSIVE)


_CASE = """
    SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS kind, count(*) AS n,
           count(DISTINCT p_brand) AS n_brands, round(min(p_retailprice), 2) AS least, round(max(p_retailprice), 2) AS most
    FROM part GROUP BY 1
"""


@query("case_buckets", _CASE)
def case_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, "part")
    return spark.sql(_CASE)


@query(
    "interval_overlap",
    """
    WITH ship AS (SELECT l_orderkey, min(l_shipdate) AS low, max(l_shipdate) + INTERVAL 1 DAY AS high FROM lineitem GROUP BY l_orderkey),
    a AS (SELECT o_orderkey AS order_key, o_custkey AS cust, o_orderdate AS low, o_orderdate + INTERVAL 60 DAY AS high FROM orders),
    b AS (SELECT o_orderkey AS ship_key, o_custkey AS cust, s.low, s.high FROM orders JOIN ship s ON o_orderkey = l_orderkey
          UNION ALL SELECT -c_custkey, c_custkey, TIMESTAMP '1900-01-01', TIMESTAMP '2100-01-01' FROM customer)
    SELECT order_key, ship_key FROM a JOIN b ON a.cust = b.cust AND a.low < b.high AND b.low < a.high
    """,
)
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order the shipping spans of its customer's orders that meet its first 60 days, and the customer's own span over all time."""
    orders, day = table(spark, sf_dir, "orders"), F.expr("interval 1 day")
    opened = orders.select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("low"), (F.col("o_orderdate") + 60 * day).alias("high"))
    spans = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("low2"), (F.max("l_shipdate") + day).alias("high2"))
    shipped = orders.join(spans, "o_orderkey").select(F.col("o_orderkey").alias("ship_key"), F.col("o_custkey").alias("cust"), "low2", "high2")
    ever = [F.lit(x).cast("timestamp_ntz") for x in ("1900-01-01", "2100-01-01")]
    always = table(spark, sf_dir, "customer").select((-F.col("c_custkey")).alias("ship_key"), F.col("c_custkey").alias("cust"), ever[0].alias("low2"), ever[1].alias("high2"))
    met = overlap_join(opened, written(shipped.unionByName(always), "shipped"), "low", "high", ["cust"], "low2", "high2")
    return met.select("order_key", "ship_key")


@query(
    "busy_spans",
    """
    WITH s AS (SELECT user_id, event_id, ts AS low, ts + to_minutes(5 + (event_id % 40)::INT * (CASE WHEN event_id % 97 = 0 THEN 600 ELSE 1 END)) AS high FROM events WHERE event_type IN ('purchase', 'error'))
    SELECT a.event_id, count(*) AS others FROM s a JOIN s b ON a.low < b.high AND b.low < a.high AND a.event_id <> b.event_id GROUP BY a.event_id
    """,
)
def busy_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other spans each span of an event overlaps, of whatever key; some spans last weeks. Pairs are counted and not made, as they grow with the square of the events of a time."""
    events = table(spark, sf_dir, "events").where("event_type in ('purchase', 'error')")
    minutes = F.expr("5 + (event_id % 40) * if(event_id % 97 = 0, 600, 1)").cast("int")
    spans = events.select("event_id", F.col("ts").alias("low"), (F.col("ts") + F.make_dt_interval(mins=minutes)).alias("high"))
    return overlap_counts(spans, "event_id", "low", "high")


_PARTNERS = "SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 47"


@query(
    "reachable_nodes",
    f"""
    WITH RECURSIVE l AS MATERIALIZED ({_PARTNERS}),
    e AS MATERIALIZED (SELECT 'supplier ' || s AS a, 'part ' || p AS b FROM l UNION ALL SELECT 'part ' || p, 'supplier ' || s FROM l),
    r(node, hops) AS (SELECT 'supplier ' || s_suppkey, 0 FROM supplier WHERE s_nationkey = 3 UNION SELECT e.b, r.hops + 1 FROM r JOIN e ON r.node = e.a WHERE r.hops < 40)
    SELECT node, min(hops)::BIGINT AS hops FROM r GROUP BY node
    """,
)
def reachable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts that large returns link to the suppliers of one nation, over any number of steps."""
    large = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 47").select("l_suppkey", "l_partkey").distinct()
    names = large.select(F.concat(F.lit("supplier "), "l_suppkey").alias("a"), F.concat(F.lit("part "), "l_partkey").alias("b"))
    both = names.unionByName(names.select(F.col("b").alias("a"), F.col("a").alias("b")))
    start = table(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.concat(F.lit("supplier "), "s_suppkey"))
    return reachable(written(both, "edges"), "a", "b", start)

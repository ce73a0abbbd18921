"""Window functions, scalar functions, time and nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions import as_long, cosine, weekday_from_sunday
from tessella.operators.neighbours import build, recall, search
from tessella.operators.ordered import ranks
from tessella.operators.series import gap_filled
from tessella.operators.sketches import estimates, in_both, merged, sketched
from tessella.operators.temporal import as_of_join, sessions, top_per_group
from tessella.plans.registry import query
from tessella.sources.scratch import written
from tessella.tables import table


@query(
    "rank_family",
    """
    SELECT c_custkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS rk,
           dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr, ntile(4) OVER w AS quarter
    FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)
    """,
)
def rank_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by nation, of whatever size: no window holds a nation."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    rows = ranks(customers, ["c_nationkey"], ["c_acctbal", "c_custkey"], {"rn": "row_number", "quarter": ("ntile", 4)}, unique=True)
    return ranks(rows, ["c_nationkey"], ["c_mktsegment"], {"rk": "rank", "dr": "dense_rank"}).select("c_custkey", "rn", "rk", "dr", "quarter")


@query(
    "global_ranks",
    """
    SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr,
           round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd, ntile(100) OVER (ORDER BY o_totalprice DESC, o_orderkey) AS percentile
    FROM orders WINDOW w AS (ORDER BY o_orderdate DESC)
    """,
)
def global_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks over the whole table as one key: by price, without ties, and by day, with many."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    rows = ranks(orders, [], ["o_totalprice desc", "o_orderkey"], {"rn": "row_number", "percentile": ("ntile", 100)}, unique=True)
    rows = ranks(rows, [], ["o_orderdate desc"], {"rk": "rank", "dr": "dense_rank", "pr": "percent_rank", "cd": "cume_dist"})
    return rows.select("o_orderkey", "rn", "rk", "dr", F.round("pr", 9).alias("pr"), F.round("cd", 9).alias("cd"), "percentile")


@query(
    "lag_lead",
    """
    SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
    """,
)
def lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"))


@query(
    "moving_average",
    """
    SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean_3
    FROM events
    """,
)
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean_3"))


@query(
    "trailing_day",
    """
    SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n_day FROM events
    """,
)
def trailing_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame of time, not of rows."""
    n = F.expr("count(1) over (partition by user_id order by ts range between interval 1 day preceding and current row)")
    return table(spark, sf_dir, "events").select("event_id", n.alias("n_day"))


@query(
    "top_supplier_per_nation",
    "SELECT s_nationkey, s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1",
)
def top_supplier_per_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_per_group(table(spark, sf_dir, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.asc("s_suppkey")], 1).select("s_nationkey", "s_suppkey")


@query(
    "string_functions",
    """
    SELECT p_partkey, upper(p_name) AS up, substring(p_name, 2, 4) AS part, replace(p_name, 'a', '*') AS swapped, lpad(p_brand, 12, '.') AS padded,
           concat_ws('/', p_brand, p_type) AS joined, CAST(instr(p_name, 'e') AS BIGINT) AS at_e, reverse(p_type) AS turned, CAST(length(p_name) AS BIGINT) AS size
    FROM part
    """,
)
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper("p_name").alias("up"), F.substring("p_name", 2, 4).alias("part"), F.replace("p_name", F.lit("a"), F.lit("*")).alias("swapped"),
        F.lpad("p_brand", 12, ".").alias("padded"), F.concat_ws("/", "p_brand", "p_type").alias("joined"), as_long(F.instr("p_name", "e")).alias("at_e"),
        F.reverse("p_type").alias("turned"), as_long(F.length("p_name")).alias("size"),
    )


@query(
    "regular_expressions",
    """
    SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_', 'g') AS masked, regexp_matches(p_brand, '[13]$') AS odd, regexp_extract(p_brand, '([0-9]+)', 1) AS digits
    FROM part
    """,
)
def regular_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.regexp_replace("p_name", "[aeiou]", "_").alias("masked"), F.col("p_brand").rlike("[13]$").alias("odd"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits")
    )


@query("edit_distance", "SELECT p_partkey, levenshtein(p_name, p_type) AS distance FROM part")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", as_long(F.levenshtein("p_name", "p_type")).alias("distance"))


@query(
    "date_functions",
    """
    SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofweek(o_orderdate) AS dow, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days,
           CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE) AS later, last_day(CAST(o_orderdate AS DATE)) AS month_end
    FROM orders
    """,
)
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", as_long(F.year(d)).alias("y"), as_long(F.month(d)).alias("m"), weekday_from_sunday(d).alias("dow"),
        as_long(F.date_diff(d, F.lit("1992-01-01").cast("date"))).alias("days"), F.add_months(d, 2).alias("later"), F.last_day(d).alias("month_end"),
    )


@query(
    "math_functions",
    """
    SELECT c_custkey, abs(c_acctbal) AS size, CAST(floor(c_acctbal) AS BIGINT) AS low, CAST(ceil(c_acctbal) AS BIGINT) AS high, round(sqrt(abs(c_acctbal)), 6) AS root,
           round(ln(abs(c_acctbal) + 1), 6) AS log, CAST(sign(c_acctbal) AS DOUBLE) AS sgn, round(c_acctbal, 1) AS tenth, c_custkey % 7 AS remainder,
           round(power(abs(c_acctbal), 0.75), 4) AS powered
    FROM customer
    """,
)
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.abs("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", a.alias("size"), as_long(F.floor("c_acctbal")).alias("low"), as_long(F.ceil("c_acctbal")).alias("high"), F.round(F.sqrt(a), 6).alias("root"),
        F.round(F.ln(a + 1), 6).alias("log"), F.sign("c_acctbal").alias("sgn"), F.round("c_acctbal", 1).alias("tenth"), (F.col("c_custkey") % 7).alias("remainder"),
        F.round(F.power(a, F.lit(0.75)), 4).alias("powered"),
    )


@query("json_path", "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("total"))


@query("variant_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def variant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query(
    "map_counts",
    "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type",
)
def map_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts gathered into a map per user and taken apart again; a map has an entry per type."""
    pairs = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = pairs.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", F.explode("m").alias("event_type", "n"))


@query("words_explode", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def words_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sorted_collect",
    "SELECT n_regionkey, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS names FROM nation GROUP BY n_regionkey",
)
def sorted_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("names"))


@query(
    "cosine_top_k",
    """
    WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]), 5) AS near FROM embeddings ORDER BY near DESC, vec_id LIMIT 10
    """,
)
def cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to one: the query is a single row."""
    vectors = table(spark, sf_dir, "embeddings")
    wanted = F.broadcast(vectors.where("vec_id = 0").select(F.col("embedding").alias("q")))
    scored = vectors.crossJoin(wanted).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 5).alias("near"))
    return scored.orderBy(F.desc("near"), "vec_id").limit(10)


@query(
    "as_of",
    """
    WITH e AS (SELECT * FROM events WHERE event_type = 'error'), p AS (SELECT user_id, max(event_id) AS event_id, ts FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
    SELECT e.event_id, p.event_id AS as_of_event_id, p.ts AS as_of_ts FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts
    """,
)
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with its user's latest purchase before it."""
    events = table(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    purchases = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return as_of_join(errors, purchases, ["user_id"], "ts", ["event_id"]).select("event_id", "as_of_event_id", "as_of_ts")


@query("tumbling_window", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "sliding_window",
    """
    SELECT start, count(*) AS n FROM (
      SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR * i AS start FROM events, range(0, 2) t(i)) GROUP BY start
    """,
)
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "events").groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query(
    "session_window",
    """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k
    """,
)
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes", F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("hash_functions", "SELECT p_partkey, md5(p_name) AS md5, sha256(p_name) AS sha256 FROM part")
def hash_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.md5("p_name").alias("md5"), F.sha2("p_name", 256).alias("sha256"))


@query("distinct_by_digest", "SELECT sha256(p_name || p_brand) AS digest, min(p_partkey) AS first_key, count(*) AS n FROM part GROUP BY digest")
def distinct_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct value by its digest: what is shuffled is 64 characters a task and value, however long the values."""
    digest = F.sha2(F.concat("p_name", "p_brand"), 256).alias("digest")
    return table(spark, sf_dir, "part").groupBy(digest).agg(F.min("p_partkey").alias("first_key"), F.count(F.lit(1)).alias("n"))


@query(
    "vector_neighbours",
    """
    SELECT vec_id AS query_id, least(10, (SELECT count(*) FROM embeddings) - 1)::BIGINT AS neighbours, TRUE AS recall_reached
    FROM embeddings WHERE vec_id % 50 = 0
    """,
)
def vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors to every fiftieth, by an index of all vectors; `recall_reached` says that at least nine in ten of them are the right ones."""
    vectors = table(spark, sf_dir, "embeddings")
    index = build(vectors, "vec_id", "embedding")
    queries = vectors.where("vec_id % 50 = 0")
    reached = recall(index, queries, "vec_id", "embedding") >= 0.9
    found = search(index, queries, "vec_id", "embedding").groupBy("query_id").agg(F.count(F.lit(1)).alias("neighbours"))
    return found.withColumn("recall_reached", F.lit(reached))


@query(
    "gap_filled_series",
    """
    WITH b AS (SELECT user_id, date_trunc('hour', ts) AS h, count(*) AS n, max_by(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2),
    s AS (SELECT user_id, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM b GROUP BY user_id),
    f AS (SELECT s.user_id, s.h, b.n, b.v, CASE WHEN b.v IS NOT NULL THEN s.h END AS seen FROM s LEFT JOIN b ON s.user_id = b.user_id AND s.h = b.h),
    w AS (SELECT *, last_value(v IGNORE NULLS) OVER past AS pv, last_value(seen IGNORE NULLS) OVER past AS pt, first_value(v IGNORE NULLS) OVER next AS nv, first_value(seen IGNORE NULLS) OVER next AS nt FROM f
      WINDOW past AS (PARTITION BY user_id ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), next AS (PARTITION BY user_id ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT user_id, h::TIMESTAMP AS ts, n, round(v, 4) AS v, round(pv, 4) AS v_carried,
      round(CASE WHEN pt = nt THEN pv ELSE pv + (nv - pv) * (date_diff('hour', pt, h)::DOUBLE / date_diff('hour', pt, nt)) END + 1e-7, 4) AS v_linear FROM w
    """,
)
def gap_filled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hourly series of each user from first to last event, with the hour's last value, the one carried on and the one on the line to the next."""
    measures = {"n": F.count(F.lit(1)), "v": F.max_by("value", F.struct("ts", "event_id"))}
    rows = gap_filled(table(spark, sf_dir, "events"), ["user_id"], "ts", 3600, measures, carried=["v"], linear=["v"])
    linear = F.round(F.col("v_linear") + 1e-7, 4)  # engines differ in how they round what lies halfway
    return rows.select("user_id", "ts", "n", F.round("v", 4).alias("v"), F.round("v_carried", 4).alias("v_carried"), linear.alias("v_linear"))


@query(
    "stored_sketches",
    """
    SELECT event_type, count(*) AS n, TRUE AS distinct_close, TRUE AS approx_close, TRUE AS shared_close, TRUE AS median_close FROM events GROUP BY event_type
    """,
)
def stored_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by day and kind of event, written, read back and merged to the month: whether what they say of users, of users who also bought and of values is within their errors."""
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "user_id", "value")
    daily = written(sketched(events, ["event_type", "day"], "user_id", "value"), "daily-sketches")
    month = merged(daily, ["event_type"])
    bought = month.where("event_type = 'purchase'").select(F.col("members").alias("buyers"))
    shared = month.crossJoin(F.broadcast(bought)).select("event_type", in_both(F.col("members"), F.col("buyers")).alias("shared"))  # one row
    said = estimates(month).join(shared, "event_type")
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    buyers = events.where("event_type = 'purchase'").select("user_id").distinct()
    both = events.join(buyers, "user_id", "left_semi").groupBy("event_type").agg(F.count_distinct("user_id").alias("users_who_bought"))
    near = lambda a, b, error: F.abs(F.col(a) - F.col(b)) <= error * F.col(b) + 1
    below = events.join(said.select("event_type", F.col("quantiles")[0].alias("median")), "event_type").groupBy("event_type").agg(
        (F.abs(F.avg((F.col("value") < F.col("median")).cast("double")) - 0.5) <= 0.03).alias("median_close"))
    met = said.join(exact, "event_type").join(both, "event_type").join(below, "event_type")
    return met.select("event_type", "n", near("distinct", "users", 0.06).alias("distinct_close"), near("approx_distinct", "users", 0.06).alias("approx_close"), near("shared", "users_who_bought", 0.1).alias("shared_close"), "median_close")

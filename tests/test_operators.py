import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella.operators.temporal import as_of_join, range_join, salted_sum, top_per_group
from tessella.sources import read, write, write_bucketed


def test_as_of_join_takes_the_latest_at_or_before(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    left = spark.createDataFrame([(1, "a", t(5)), (2, "a", t(1)), (3, "b", t(9)), (4, None, t(3))], "id int, k string, ts timestamp")
    right = spark.createDataFrame([("a", t(5), 1), ("a", t(5), 7), ("a", t(3), 3), ("b", t(10), 4), (None, t(1), 9), ("a", None, 8)], "k string, ts timestamp, v int")
    rows = as_of_join(left, right, ["k"], "ts", ["v"])
    assert sorted((r.id, r.as_of_v) for r in rows.collect()) == [(1, 7), (2, None), (3, None), (4, None)]
    assert rows.columns == ["id", "k", "ts", "as_of_ts", "as_of_v"]


def test_as_of_join_of_a_hot_key(spark):
    """Nine tenths of both sides have one key, whose rows stand in many ranges."""
    side = lambda n, m: spark.range(n).select((F.col("id") * m % 997).cast("int").alias("t"), F.when(F.col("id") % 10 == 0, F.col("id") % 3).otherwise(7).alias("k"), F.col("id").alias("v"))
    left, right = side(900, 7), side(300, 31)
    got = as_of_join(left, right, ["k"], "t", ["v"], rows=50)
    best = left.alias("a").join(right.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("b.t") <= F.col("a.t")), "left")
    want = best.groupBy("a.t", "a.k", "a.v").agg(F.max(F.struct("b.t", "b.v")).alias("m")).select("t", "k", "v", "m.t", "m.v")
    assert sorted(map(str, got.collect())) == sorted(str(r).replace("t=", "as_of_t=").replace("v=", "as_of_v=").replace("as_of_t=", "t=", 1).replace("as_of_v=", "v=", 1) for r in want.collect())


def test_range_join_equals_comparing_all(spark):
    points = spark.range(200).select((F.col("id") * 1.7 - 50).alias("x"))
    ranges = spark.range(40).select(F.col("id").alias("r"), (F.col("id") * 9.0 - 60).alias("a"), (F.col("id") * 9.0 - 60 + F.col("id") % 7 * 5).alias("b"))
    got = range_join(points, ranges, "x", "a", "b", 10.0).select("x", "r")
    want = points.crossJoin(ranges).where("x >= a and x < b").select("x", "r")
    assert sorted(got.collect()) == sorted(want.collect())


def test_range_join_with_ranges_of_any_length(spark):
    points = spark.createDataFrame([(x,) for x in (-1e12, -3.5, 0.0, 1.0, 9.99, 1e9, None, float("nan"))], "x double")
    ranges = spark.createDataFrame([(1, -1e15, 1e15), (2, 0.0, 1.0), (3, 1.0, 1.0), (4, None, 5.0), (5, -4.0, 10.0), (6, 5.0, -5.0)], "r int, a double, b double")
    got = range_join(points, ranges, "x", "a", "b", 1.0)
    assert sorted((r.x, r.r) for r in got.collect()) == [(-1e12, 1), (-3.5, 1), (-3.5, 5), (0.0, 1), (0.0, 2), (0.0, 5), (1.0, 1), (1.0, 5), (9.99, 1), (9.99, 5), (1e9, 1)]
    assert range_join(points, ranges.where("false"), "x", "a", "b", 1.0).columns == ["x", "r", "a", "b"]


def test_salted_sum_and_top(spark):
    df = spark.createDataFrame([("a", i, i * 2) for i in range(50)] + [("b", 1, 1), (None, 3, 3)], "k string, i int, v int")
    assert {r.k: r.s for r in salted_sum(df, ["k"], "v", 8, "s").collect()} == {"a": 2450, "b": 1, None: 3}
    top = top_per_group(df, ["k"], [F.desc("v")], 2)
    assert sorted((str(r.k), r.v) for r in top.collect()) == [("None", 3), ("a", 96), ("a", 98), ("b", 1)]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a,b", 1.5), (2, None, None)], "id int, s string, v double")
    write(df, str(tmp_path / fmt), fmt, partition_by=["id"] if fmt == "parquet" else ())
    back = read(spark, str(tmp_path / fmt), fmt, df.schema if fmt != "parquet" else None)
    assert sorted(back.select("id", "s", "v").collect()) == sorted(df.collect())


def test_formats_are_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        read(spark, "x", "xml")
    with pytest.raises(ValueError):
        read(spark, "x", "csv")
    with pytest.raises(ValueError):
        write(spark.range(1), "x", "xml")


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    spark.sql("drop table if exists bucketed_a")
    spark.sql("drop table if exists bucketed_b")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("bucketed_a", "bucketed_b"):
            write_bucketed(spark.range(100).withColumnRenamed("id", "k"), name, 4, ["k"])
        joined = spark.table("bucketed_a").join(spark.table("bucketed_b"), "k")
        assert joined.count() == 100
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("drop table if exists bucketed_a")
        spark.sql("drop table if exists bucketed_b")


def test_exact_quantiles(spark):
    import numpy as np

    from tessella.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(1)
    rows = [(None if k == 2 else f"g{k}", float(x)) for k in range(4) for x in (*rng.normal(size=700), *[0.25] * 400)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.a, r.b, r.c) for r in exact_quantiles(df, ["g"], "v", {"a": 0.0, "b": 0.37, "c": 0.5}).collect()}
    assert set(got) == {r[0] for r in rows} - {"none"}
    for g, found in got.items():
        want = np.quantile([v for k, v in rows if k == g], [0.0, 0.37, 0.5])
        assert np.allclose(found, want)


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    import pytest

    from tessella.sources.scratch import scratch

    context = SimpleNamespace(master="spark://somewhere:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(RuntimeError):
        scratch(session, "x")


def test_bucketed_join_shuffles_neither_side(spark):
    from tessella.plans.udfs import bucketed_join

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = bucketed_join(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1  # that of the sum


def test_rebalanced_rows_are_all_there(spark):
    from tessella.sources import rebalanced

    df = spark.range(1000).selectExpr("id", "if(id < 900, 'hot', cast(id as string)) as k")
    out = rebalanced(df, ["k"])
    assert out.count() == 1000 and "REBALANCE" in out._jdf.queryExecution().executedPlan().toString().upper()


def test_dominance_counts(spark):
    import random

    from tessella.operators.temporal import dominance_counts

    rnd = random.Random(2)
    rows = [(i, "ab"[i % 2], float(rnd.randrange(12)), rnd.randrange(20)) for i in range(300)] + [(900, "a", None, 3), (901, None, 1.0, 0), (902, None, 0.0, 5)]
    got = {r.k: r.n for r in dominance_counts(spark.createDataFrame(rows, "k long, g string, x double, y int"), ["g"], "k", "x", "y", "n").collect()}
    want = {}
    for k, g, x, y in rows:
        n = sum(h == g and g is not None and u is not None and x is not None and u > x and v < y for _, h, u, v in rows)
        if n:
            want[k] = n
    assert got == want

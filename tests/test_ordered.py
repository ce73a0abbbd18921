"""Ranks and running values in ranges against windows, with one key of nine tenths of the rows."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.ordered import ranks, running

KINDS = {"rn": "row_number", "rk": "rank", "dr": "dense_rank", "pr": "percent_rank", "cd": "cume_dist", "nt": ("ntile", 7)}


def _rows(n: int, values: int, seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    key = lambda: "hot" if rnd.random() < 0.9 else rnd.choice([None, "a", "b", "c"])
    return [(i, key(), rnd.choice([None, *range(values)]), rnd.randrange(100)) for i in range(n)]


SCHEMA = "id long, k string, v int, w int"


@pytest.mark.parametrize(("values", "direction", "by"), [(1, "", []), (3, " desc", ["k"]), (3, "", []), (5000, " desc", []), (5000, "", ["k"])])
def test_ranks_equal_windows(spark, values, direction, by):
    df = spark.createDataFrame(_rows(600, values, values), SCHEMA).repartition(3)
    got = ranks(df, by, [f"v{direction}"], KINDS, rows=40)
    assert got.columns == [*df.columns, *KINDS]
    keyed = W.partitionBy(*by) if by else W.partitionBy()
    w = keyed.orderBy(F.desc("v") if direction else F.asc("v"))
    want = df.select("id", F.rank().over(w), F.dense_rank().over(w), F.percent_rank().over(w), F.cume_dist().over(w))
    assert sorted(got.select("id", "rk", "dr", "pr", "cd").collect()) == sorted(want.collect())
    exact = ranks(df, by, [f"v{direction}", "id"], KINDS, rows=40, unique=True)
    w = keyed.orderBy(F.desc("v") if direction else F.asc("v"), "id")
    want = df.select("id", F.row_number().over(w), F.rank().over(w), F.ntile(7).over(w))
    assert sorted(exact.select("id", "rn", "rk", "nt").collect()) == sorted(want.collect())
    by_key = {}
    for r in got.collect():  # numbers of ties differ, but are gapless and in order
        by_key.setdefault(r.k if by else 0, []).append((r.rn, r.rk))
    for pairs in by_key.values():
        assert [n for n, _ in sorted(pairs)] == list(range(1, len(pairs) + 1))
        assert [k for _, k in sorted(pairs)] == sorted(k for _, k in pairs)


def test_small_and_empty_tables(spark):
    assert ranks(spark.createDataFrame([], SCHEMA), ["k"], ["v"], KINDS).collect() == []
    one = ranks(spark.createDataFrame([(1, None, None, 0)], SCHEMA), ["k"], ["v"], KINDS).first()
    assert (one.rn, one.rk, one.dr, one.pr, one.cd, one.nt) == (1, 1, 1, 0.0, 1.0, 1)
    same = ranks(spark.createDataFrame([(1, "x", 2, 3)] * 100, SCHEMA), ["k"], ["v"], {"rn": "row_number", "rk": "rank", "cd": "cume_dist"}, rows=10).collect()
    assert sorted(r.rn for r in same) == list(range(1, 101)) and {(r.rk, r.cd) for r in same} == {(1, 1.0)}
    with pytest.raises(ValueError):
        ranks(spark.range(1), [], ["id"], {"x": "median"})


def test_ranks_replace_columns_of_their_names(spark):
    out = ranks(spark.range(5).withColumn("rk", F.lit("old")), [], ["id desc"], {"rk": "rank"}, unique=True)
    assert out.columns == ["id", "rk"] and sorted((r.id, r.rk) for r in out.collect()) == [(i, 5 - i) for i in range(5)]


def test_running_values_equal_windows(spark):
    df = spark.createDataFrame(_rows(500, 30, 9), SCHEMA).withColumn("last", F.when(F.col("w") < 5, F.col("w")))
    got = running(df, ["k"], ["v desc", "id"], sums={"s": F.col("w"), "t": F.col("last")}, lasts={"l": F.col("last")}, rows=30, unique=True)
    w = W.partitionBy("k").orderBy(F.desc("v"), "id").rowsBetween(W.unboundedPreceding, 0)
    want = df.withColumns({"s": F.sum("w").over(w), "t": F.sum("last").over(w), "l": F.last("last", ignorenulls=True).over(w)})
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("rows", [30, 200_000])
def test_next_values_equal_windows(spark, rows):
    df = spark.createDataFrame(_rows(500, 30, 9), SCHEMA).withColumn("seen", F.when(F.col("w") < 5, F.col("w")))
    got = running(df, ["k"], ["v desc", "id"], sums={"s": F.col("w")}, lasts={"l": F.col("seen")}, nexts={"n": F.col("seen"), "i": F.col("id")}, rows=rows, unique=True)
    w = W.partitionBy("k").orderBy(F.desc("v"), "id")
    upto, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(1, W.unboundedFollowing)
    want = df.withColumns({"s": F.sum("w").over(upto), "l": F.last("seen", ignorenulls=True).over(upto), "n": F.first("seen", ignorenulls=True).over(after), "i": F.first("id").over(after)})
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_no_window_holds_a_hot_key(spark):
    """Ranges of one key of the whole table stay near their size, ties included."""
    from tessella.operators.ordered import in_ranges

    df = spark.range(4000).select(F.lit("k").alias("k"), F.lit(1).alias("v"))
    sizes = [r["count"] for r in in_ranges(df, ["k"], ["v"], rows=250).groupBy("__range").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 800

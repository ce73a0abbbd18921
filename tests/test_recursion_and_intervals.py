import random

import pytest
from pyspark.sql import functions as F

from tessella.operators.fixpoint import fixpoint, reachable
from tessella.operators.intervals import overlap_counts, overlap_join


def _spans(n, seed, hot=0.0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        low = 500 if rnd.random() < hot else rnd.randrange(-1000, 1000)
        rows.append((i, rnd.choice(["x", "x", "y", None]), low, low + rnd.choice([0, 1, 2, 3, 7, 8, 64, 700])))
    return rows + [(n, "x", -(10**12), 10**12), (n + 1, "y", None, 5), (n + 2, "y", 5, None), (n + 3, "x", 9, 3)]


@pytest.mark.parametrize(("by", "cell_rows", "hot"), [(["k"], 100_000, 0.0), ([], 100_000, 0.5), ([], 5, 0.9)])
def test_overlaps_equal_comparing_all(spark, by, cell_rows, hot):
    a, b = _spans(150, 1, hot), _spans(120, 2, hot)
    left = spark.createDataFrame(a, "i long, k string, low long, high long").repartition(3)
    right = spark.createDataFrame(b, "j long, k string, low2 long, high2 long")
    right = right if by else right.withColumnRenamed("k", "k2")
    got = overlap_join(left, right, "low", "high", by, "low2", "high2", cell_rows)
    full = lambda r: None not in r[2:] and r[2] < r[3]
    want = [(x[0], y[0]) for x in a for y in b if full(x) and full(y) and x[2] < y[3] and y[2] < x[3] and (not by or x[1] is not None and x[1] == y[1])]
    assert sorted((r.i, r.j) for r in got.collect()) == sorted(want)
    assert got.columns == ["i", "k", "low", "high", "j", *([] if by else ["k2"]), "low2", "high2"]


def test_dates_and_empty_sides(spark):
    a = spark.sql("select 1 as i, date '2024-01-01' as low, date '2024-01-03' as high union all select 2, date '2024-01-03', date '2024-01-04'")
    b = a.select(F.col("i").alias("j"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    assert sorted((r.i, r.j) for r in overlap_join(a, b, "low", "high", (), "low2", "high2").collect()) == [(1, 1), (2, 2)]
    assert overlap_join(a, b.where("false"), "low", "high", (), "low2", "high2").collect() == []


def test_a_long_range_isn_t_copied_by_its_length(spark):
    long = spark.range(1).select(F.lit(-(2**50)).alias("low"), F.lit(2**50).alias("high"))
    many = spark.range(1000).select(F.col("id").alias("j"), F.col("id").alias("low2"), (F.col("id") + 1).alias("high2"))
    assert overlap_join(long, many, "low", "high", (), "low2", "high2").count() == 1000


@pytest.mark.parametrize("few", [1, 8, 1000])
def test_keys_of_few_rows_meet_without_copies(spark, few):
    a, b = ([(i, i % 5 if i % 3 else 0, low, high) for i, _, low, high in _spans(90, s)] for s in (5, 6))
    left, right = spark.createDataFrame(a, "i long, k long, low long, high long"), spark.createDataFrame(b, "j long, k long, low2 long, high2 long")
    got = overlap_join(left, right, "low", "high", ["k"], "low2", "high2", few=few)
    full = lambda r: None not in r and r[2] < r[3]
    want = [(x[0], y[0]) for x in a for y in b if full(x) and full(y) and x[1] == y[1] and x[2] < y[3] and y[2] < x[3]]
    assert sorted((r.i, r.j) for r in got.collect()) == sorted(want)
    if few == 1000:
        plan = got.select("i", "j")._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Union" not in plan


@pytest.mark.parametrize(("keys", "rows"), [(1000, 200_000), (1000, 20), (40, 20)])
def test_overlap_counts_equal_comparing_all(spark, keys, rows):
    made = [(None if i == 7 else i % keys, low, high) for i, _, low, high in _spans(150, 3, 0.2)]
    got = overlap_counts(spark.createDataFrame(made, "i long, low long, high long").repartition(3), "i", "low", "high", rows)
    full = [x for x in made if None not in x and x[1] < x[2]]
    pairs = [a[0] for a in full for b in full if a[0] != b[0] and a[1] < b[2] and b[1] < a[2]]
    assert {r.i: r.others for r in got.collect()} == {i: pairs.count(i) for i in set(pairs)}


def test_overlaps_are_counted_without_pairs(spark):
    many = spark.range(200_000).select("id", F.lit(0).alias("low"), F.lit(9).alias("high"))  # 4 * 10^10 pairs
    got = overlap_counts(many, "id", "low", "high")
    assert got.agg(F.min("others"), F.max("others"), F.count("id")).first()[:] == (199_999, 199_999, 200_000)


def test_reachable_equals_a_search(spark):
    rnd = random.Random(4)
    edges = [(rnd.choice([0, rnd.randrange(80)]), rnd.randrange(80)) for _ in range(110)] + [(None, 3), (3, None), (200, 201), (5, 5)]
    hops, front = {0: 0, 7: 0, 999: 0}, [0, 7, 999]
    while front:
        front = [b for a in front for x, b in edges if x == a and b is not None and b not in hops and not hops.update({b: hops[a] + 1})]
    start = spark.createDataFrame([(0,), (7,), (7,), (None,), (999,)], "n long")
    got = reachable(spark.createDataFrame(edges, "s long, t long"), "s", "t", start, compact_every=2)
    assert {r.node: r.hops for r in got.collect()} == hops and got.count() == len(hops)


def test_fixpoint_over_rows_with_nulls(spark):
    start = spark.createDataFrame([(1, None), (1, None), (2, "a")], "n int, s string")
    rows = fixpoint(start, lambda new: new.where("n < 5").select((F.col("n") + 1).alias("n"), "s")).collect()
    assert sorted((r.n, str(r.s), r["round"]) for r in rows) == [(1, "None", 0), (2, "None", 1), (2, "a", 0), (3, "None", 2), (3, "a", 1), (4, "None", 3), (4, "a", 2), (5, "None", 4), (5, "a", 3)]
    with pytest.raises(RuntimeError):
        fixpoint(start, lambda new: new.select((F.col("n") + 1).alias("n"), "s"), most_rounds=3)
    assert fixpoint(start.where("false"), lambda new: new).collect() == []

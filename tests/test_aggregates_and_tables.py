import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import aggregates
from tessella.operators.aggregates import LongestRise, exact_sum, longest_rise, regression
from tessella.operators.tables import CHANGES
from tessella.shipping import ship


def test_sums_are_exact_in_any_order(spark):
    rnd = random.Random(1)
    values = [rnd.choice([1e16, -1e16, 1.0, 1e-9, rnd.random(), -rnd.random() * 1e5]) for _ in range(3000)]
    rows = [("hot" if i % 10 else rnd.choice(["a", None]), v) for i, v in enumerate(values)] + [("hot", None), ("empty", None), ("inf", math.inf), ("inf", 1.0), ("nan", math.inf), ("nan", -math.inf)]
    want = {k: math.fsum(v for g, v in rows if g == k and v is not None) for k in ("hot", "a", None)}
    for n in (1, 7):
        df = spark.createDataFrame(rows, "k string, v double").repartition(n)
        got = {r.k: r.s for r in exact_sum(df, ["k"], "v", "s").collect()}
        assert {k: got[k] for k in want} == want
        assert got["empty"] is None and got["inf"] == math.inf and math.isnan(got["nan"])


def test_regression_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "HELD_KEYS", 1)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 2)) * [1, 50] + [1e6, -3]
    keys = np.where(rng.random(4000) < 0.9, 1, rng.integers(2, 5, 4000))
    y = 7 + x @ [2.5, -0.5] + rng.normal(size=4000)
    rows = [(int(k), float(a), float(b), float(c)) for k, (a, b), c in zip(keys, x, y, strict=True)] + [(9, 1.0, 1.0, 1.0), (1, None, 2.0, 3.0), (8, 1.0, 2.0, 3.0), (8, 2.0, 4.0, 3.0), (8, 3.0, 6.0, 4.0), (8, 4.0, 8.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, a double, b double, y double").repartition(6)
    got = {r.g: r.coefficients for r in regression(df, ["g"], ["a", "b"], "y").collect()}
    assert set(got) == {1, 2, 3, 4, 8, 9} and got[8] is None and got[9] is None
    for k in (1, 2, 3, 4):
        own = keys == k
        want = np.linalg.lstsq(np.column_stack([np.ones(own.sum()), x[own] - [1e6, 0]]), y[own], rcond=None)[0]
        assert np.allclose(got[k][1:], want[1:]) and math.isclose(got[k][0], want[0] - 1e6 * want[1], rel_tol=1e-6)


def test_states_move_and_no_rows(spark):
    """What is shuffled is a state a task and key."""
    df = spark.range(0, 100_000, 1, 5).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    out = exact_sum(df, ["k"], "v", "s")
    assert out.first().s == 4999950000.0 and out.columns == ["k", "s"]
    assert exact_sum(df.where("false"), ["k"], "v", "s").collect() == []


def _rise(values: list[float | None]) -> int:
    best = run = 1
    for a, b in zip(values, values[1:], strict=False):
        run = run + 1 if a is not None and b is not None and b > a else 1
        best = max(best, run)
    return best


def test_longest_rise_of_a_hot_key_over_many_ranges(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.9 else rnd.choice(["a", "b", None]), t, rnd.choice([None, *map(float, range(8))]) if t % 300 > 120 else float(t)) for t in range(3000)]
    df = spark.createDataFrame(rows, "k string, t long, v double").repartition(5)
    got = {r.k: r.longest for r in longest_rise(df, ["k"], ["t"], "v", rows=100).collect()}
    assert got == {k: _rise([v for g, _, v in rows if g == k]) for k in ("hot", "a", "b", None)}
    back = {r.k: r.longest for r in longest_rise(df, ["k"], ["t desc"], "v", rows=100).collect()}
    assert back == {k: _rise([v for g, _, v in reversed(rows) if g == k]) for k in ("hot", "a", "b", None)}
    one = longest_rise(df, [], ["t"], "v", "n", rows=100)
    assert one.columns == ["n"] and [r.n for r in one.collect()] == [_rise([v for _, _, v in rows])]
    assert longest_rise(df.where("false"), ["k"], ["t"], "v").collect() == []


def test_stretches_merge_wherever_they_are_cut():
    rnd = random.Random(6)
    for _ in range(200):
        x = np.array([rnd.choice([math.nan, *range(6)]) for _ in range(rnd.randint(1, 25))], float)
        cuts = sorted(rnd.randint(0, len(x)) for _ in range(3))
        state = LongestRise().create()
        for part in np.split(x, cuts):
            state = LongestRise().update(state, [part])
        assert LongestRise().result(state) == _rise([None if math.isnan(v) else v for v in x])


@pytest.fixture
def changes(spark):
    ship(spark)
    spark.udtf.register("changes", CHANGES)
    return spark


def test_schema_follows_the_table(changes):
    rows = [("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 6.0), ("a", 4, 5.0), ("b", 1, None), ("b", 2, None), ("b", 3, 1.0)]
    changes.createDataFrame(rows, "k string, t int, v double").createOrReplaceTempView("readings")
    got = changes.sql("SELECT * FROM changes(TABLE(readings) PARTITION BY (k) ORDER BY (t), 'v')")
    assert got.columns == ["k", "t", "v", "run_rows"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1, 5.0, 2), ("a", 3, 6.0, 1), ("a", 4, 5.0, 1), ("b", 1, None, 2), ("b", 3, 1.0, 1)], key=str)
    other = changes.sql("SELECT * FROM changes(TABLE(SELECT k, v FROM readings) PARTITION BY (k) ORDER BY (v))")
    assert other.columns == ["k", "v", "run_rows"] and other.count() == 4
    assert changes.sql("SELECT * FROM changes(TABLE(SELECT * FROM readings WHERE false) PARTITION BY (k) ORDER BY (t))").collect() == []
    assert changes.createDataFrame(rows, "k string, t int, v double").count() == changes.sql("SELECT sum(run_rows) AS n FROM changes(TABLE(readings) PARTITION BY (k) ORDER BY (t), 'v')").first().n


@pytest.mark.parametrize("call", ["changes('x')", "changes(TABLE(SELECT 1 AS a), 'b')", "changes(TABLE(SELECT 1 AS run_rows))"])
def test_wrong_calls_fail_at_analysis(changes, call):
    with pytest.raises(Exception, match="table"):
        changes.sql(f"SELECT * FROM {call}")

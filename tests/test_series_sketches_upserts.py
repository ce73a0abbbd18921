import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import series
from tessella.operators.series import gap_filled
from tessella.operators.sketches import estimates, in_both, merged, sketched
from tessella.streaming import UpsertTable

START = dt.datetime(2024, 1, 1)


def _brute(rows, step):
    """(key, step's start, value, carried, linear) of (key, seconds, value)."""
    out = []
    for key in {k for k, _, _ in rows}:
        cells = {}
        for k, t, v in sorted((r for r in rows if r[0] == key and r[1] is not None), key=lambda r: (r[1], r[2] is not None, r[2] or 0)):
            cells.setdefault(t // step, []).append(v)
        if not cells:
            continue
        value = {s: max((v for v in vs if v is not None), default=None) for s, vs in cells.items()}
        known = sorted(s for s, v in value.items() if v is not None)
        for s in range(min(cells), max(cells) + 1):
            before, after = [x for x in known if x <= s], [x for x in known if x >= s]
            a, b = (before or [None])[-1], (after or [None])[0]
            line = None if a is None or b is None else value[a] if a == b else value[a] + (value[b] - value[a]) * (s - a) / (b - a)
            out.append((key, START + dt.timedelta(seconds=s * step), value.get(s), None if a is None else value[a], None if line is None else round(line, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_per_range", [15, 200_000])
def test_series_equal_brute_force(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(series, "CHUNK", 7)
    rnd = random.Random(rows_per_range)
    rows = [(("hot" if rnd.random() < 0.9 else rnd.choice(["a", None])), rnd.randrange(-3000, 20_000), rnd.choice([None, 1.5, 2.0, 7.25])) for _ in range(120)] + [("once", 5, 1.0), ("nulls", 5, None), ("nulls", 4000, None), ("never", None, 3.0)]
    df = spark.createDataFrame([(k, None if t is None else START + dt.timedelta(seconds=t), v) for k, t, v in rows], "k string, t timestamp_ntz, v double").repartition(3)
    got = gap_filled(df, ["k"], "t", 600, {"v": F.max("v")}, carried=["v"], linear=["v"], rows=rows_per_range)
    assert got.columns == ["k", "t", "v", "v_carried", "v_linear"]
    plain = [(r.k, r.t, r.v, r.v_carried, None if r.v_linear is None else round(r.v_linear, 6)) for r in got.collect()]
    assert sorted(plain, key=str) == _brute(rows, 600)


def test_series_of_empty_tables_and_without_keys(spark):
    df = spark.createDataFrame([(START, 1.0), (START + dt.timedelta(hours=3), 4.0)], "t timestamp, v double")
    got = gap_filled(df, [], "t", 3600, {"v": F.max("v"), "n": F.count(F.lit(1))}, carried=["v"], linear=["v"])
    assert sorted((r.v_carried, r.v_linear, r.n) for r in got.collect()) == sorted([(1.0, 1.0, 1), (1.0, 2.0, None), (1.0, 3.0, None), (4.0, 4.0, 1)], key=lambda x: x[:2])
    assert gap_filled(df.where("false"), [], "t", 3600, {"v": F.max("v")}, carried=["v"]).collect() == []


def test_what_fills_gaps_is_neither_moved_nor_sorted(spark, monkeypatch):
    moved = []
    plain = series.running
    monkeypatch.setattr(series, "running", lambda df, *a, **k: moved.append(df.count()) or plain(df, *a, **k))
    df = spark.createDataFrame([("x", START, 0.0), ("x", START + dt.timedelta(days=30), 1.0), ("y", START, 5.0)], "k string, t timestamp, v double")
    got = gap_filled(df, ["k"], "t", 60, {"v": F.max("v")}, carried=["v"], linear=["v"])
    assert got.groupBy("k").agg(F.count("v_linear").alias("n"), F.count("v").alias("own"), F.round(F.sum("v_linear"), 3).alias("s")).orderBy("k").collect() == [("x", 43_201, 2, 21_600.5), ("y", 1, 1, 5.0)]
    assert moved == [3]


def test_sketches_merge_to_what_all_rows_give(spark):
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("m"), (F.col("id") / 60_000).alias("v"), (F.col("id") % 30).alias("day"), F.when(F.col("id") % 20_000 < 8000, "x").otherwise("y").alias("k"))
    month = merged(sketched(df, ["k", "day"], "m", "v"), ["k"])
    got = {r.k: r for r in estimates(month, [0.1, 0.9]).collect()}
    assert abs(got["x"].distinct - 8000) < 500 and abs(got["y"].approx_distinct - 12_000) < 700 and got["x"].n + got["y"].n == 60_000
    assert abs(got["y"].quantiles[1] - df.where("k = 'y'").agg(F.percentile("v", F.lit(0.9))).first()[0]) < 0.03
    even = sketched(df.where("m % 2 = 0"), [F.lit(1).alias("one")], "m", "v").select(F.col("members").alias("even"))
    shared = month.where("k = 'x'").crossJoin(even).select(in_both(F.col("members"), F.col("even")).alias("n")).first().n
    assert abs(shared - 4000) < 400
    nothing = estimates(sketched(spark.createDataFrame([("a", None, None)], "k string, m long, v double"), ["k"], "m", "v")).first()
    assert (nothing.n, nothing.distinct, nothing.quantiles) == (1, 0, None)


def test_upserts_can_come_again(spark, tmp_path):
    held = UpsertTable(spark, str(tmp_path / "t"), "k string, n long, v string", ["k"], "n")
    df = lambda rows: spark.createDataFrame(rows, "k string, n long, v string, gone boolean")
    assert held.read().collect() == []
    held.write(df([("a", 1, "a1", False), ("a", 3, "a3", False), ("b", 1, "b1", False), (None, 1, "n1", False), ("d", None, "d0", False)]), 0)
    held.write(df([("a", 2, "late", False), ("b", 2, None, True), ("c", 1, "c1", False)]), 1)
    state = [("a", 3, "a3"), ("c", 1, "c1"), ("d", None, "d0"), (None, 1, "n1")]
    rows = lambda x: sorted(map(tuple, x.collect()), key=str)
    assert rows(held.read()) == sorted(state, key=str)
    held.write(df([("a", 2, "late", False), ("b", 2, None, True), ("c", 1, "c1", False)]), 1)  # the same batch again
    assert rows(held.read()) == sorted(state, key=str)
    held.write(df([("c", 1, "half a batch", False)]), 2)
    held.write(df([("c", 1, "again", False), ("b", 3, "b3", False)]), 2)  # replaces what it wrote
    after = [("a", 3, "a3"), ("b", 3, "b3"), ("c", 1, "again"), ("d", None, "d0"), (None, 1, "n1")]
    assert rows(held.read()) == sorted(after, key=str) and rows(held.read(upto=1)) == sorted(state, key=str)
    held.compact(1)
    held.write(df([("b", 1, "older than the deletion", False)]), 3)
    assert rows(held.read()) == sorted(after, key=str)
    (tmp_path / "t" / "batch-000000000009").mkdir()  # begun and never ended
    assert rows(held.read()) == sorted(after, key=str)


def test_a_job_that_dies_after_its_write(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select((F.col("id") % 4).cast("string").alias("k"), F.col("id").alias("n"), F.lit(f"b{i}").alias("v")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    held = UpsertTable(spark, str(tmp_path / "t"), "k string, n long, v string", ["k"], "n")
    deaths, numbers = [], []

    def put(batch, number):
        held.write(batch, number)
        numbers.append(number)
        if number < 2 and number not in deaths:
            deaths.append(number)
            raise RuntimeError("dies")

    stream = spark.readStream.schema("k string, n long, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(3):
        job = stream.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        try:
            job.awaitTermination()
        except Exception as e:
            assert "dies" in str(e)
    assert numbers == [0, 0, 1, 1, 2]
    assert sorted((r.k, r.n) for r in held.read().collect()) == [("0", 28), ("1", 29), ("2", 26), ("3", 27)]


def _batches(spark, tmp_path, days):
    for d in days:
        rows = [(u, START + dt.timedelta(days=d, minutes=u * 7 + i), float(i)) for u in range(20) for i in range(3) if d < 3 or u < 2]
        spark.createDataFrame(rows, "u long, ts timestamp, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema("u long, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")


@pytest.mark.parametrize("name", ["first_of_window", "running_totals"])
def test_state_goes_when_its_time_is_over(spark, tmp_path, name):
    from tessella import streaming

    stream = _batches(spark, tmp_path, range(8))
    made = streaming.first_of_window(stream, "ts", "1 day", "u") if name == "first_of_window" else streaming.running_totals(stream, "u", "v", "ts", "1 day")
    out = []
    job = made.writeStream.foreachBatch(lambda df, i: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    job.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in job.recentProgress if p.stateOperators]
    assert max(held) <= 60 and held[-1] <= 6, held
    if name == "first_of_window":
        assert len(out) == len(set(out)) == 3 * 20 + 5 * 2
    else:
        last = {}
        for r in out:
            last[r.u, r.since] = max(last.get((r.u, r.since), (0, 0.0)), (r.n, r.total))
        assert sum(n for n, _ in last.values()) == 3 * (3 * 20 + 5 * 2)


def test_replays_bring_a_part_a_batch_from_several_files(spark):
    from tessella.streaming import replayed

    events = spark.range(0, 1000, 1, 6)
    stream = replayed([events.where("id < 400"), events.where("id >= 990"), events.where("false"), events.where("id between 400 and 989")], "several")
    sizes = []
    job = stream.writeStream.foreachBatch(lambda df, i: sizes.append((df.count(), df.select(F.input_file_name()).distinct().count()))).trigger(availableNow=True).start()
    job.awaitTermination()
    assert sizes == [(400, 3), (10, 1), (0, 0), (590, 4)]


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("name", ["running_totals", "visit_starts"])
def test_state_is_held_by_bucket(spark, monkeypatch, name, kind):
    """Calls of Python and rows of state are as many as buckets, and results those of each key."""
    import pandas as pd

    from tessella import streaming

    rnd = random.Random(5)
    rows = [(rnd.choice([None, *range(2**60, 2**60 + 40)]), START + dt.timedelta(minutes=rnd.randrange(20_000)), float(rnd.randrange(9))) for _ in range(900)]
    df = spark.createDataFrame(rows, "u long, ts timestamp, v double").withColumn("u", F.col("u").cast(kind)).repartition(3)
    cuts = [START + dt.timedelta(days=d) for d in (0, 3, 4, 11, 99)]
    stream = streaming.with_event_time(streaming.replayed([df.where(F.col("ts").between(a, b - dt.timedelta(seconds=1))) for a, b in zip(cuts, cuts[1:])], name), "ts", "1 hour")
    day, provider = pd.Timedelta(days=1), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        made = streaming.running_totals(stream, "u", "v", "ts", "1 day", buckets=4) if name == "running_totals" else streaming.visit_starts(stream, "u", "ts", day, buckets=4)
        out, held = [], []
        job = made.writeStream.foreachBatch(lambda b, i: out.extend(b.collect())).trigger(availableNow=True).start()
        job.awaitTermination()
        held = [p.stateOperators[0].numRowsTotal for p in job.recentProgress if p.stateOperators]
    finally:
        spark.conf.set(provider, before)
    assert 0 < max(held) <= 5 * (1 if name == "running_totals" else 4), held
    key = (lambda k: k) if kind == "long" else (lambda k: None if k is None else str(k))
    if name == "running_totals":
        last = {}
        for r in out:
            last[r.u, r.since] = max(last.get((r.u, r.since), (0, 0.0)), (r.n, r.total))
        got = {k: (sum(n for (u, _), (n, _) in last.items() if u == k), sum(x for (u, _), (_, x) in last.items() if u == k)) for k, _ in last}
        assert got == {key(k): (sum(u == k for u, _, _ in rows), sum(v for u, _, v in rows if u == k)) for k in {u for u, _, _ in rows}}
    else:
        want = []
        for k in {u for u, _, _ in rows}:
            times = sorted(t for u, t, _ in rows if u == k)
            want += [(key(k), t) for i, t in enumerate(times) if not i or t - times[i - 1] >= dt.timedelta(days=1)]
        assert sorted(((r.u, r.start) for r in out), key=str) == sorted(want, key=str)

"""The Python data source: partitions that filters leave out, and streams in batches."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessella.shipping import ship
from tessella.sources.segments import SegmentSource, segment_rows

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@pytest.fixture
def source(spark):
    ship(spark)
    spark.dataSource.register(SegmentSource)
    before = spark.conf.get(PUSHDOWN)
    spark.conf.set(PUSHDOWN, "true")
    yield spark
    spark.conf.set(PUSHDOWN, before)


def fill(folder, files=3, groups=4, rows=5):
    """Row groups of rising k; the last of each file has nulls only in s."""
    n = 0
    for i in range(files):
        with pq.ParquetWriter(folder / f"part-{i}.parquet", pa.schema([("k", pa.int64()), ("s", pa.string()), ("t", pa.timestamp("us"))])) as w:
            for g in range(groups):
                k = list(range(n, n + rows))
                s = [None if g == groups - 1 else f"s{x:03d}" for x in k]
                w.write_table(pa.table([k, s, [dt.datetime(2024, 1, 1) + dt.timedelta(hours=x) for x in k]], schema=w.schema))
                n += rows
    (folder / "_SUCCESS").touch()
    return n


@pytest.mark.parametrize(
    ("condition", "segments"),
    [
        ("true", 12), ("k >= 50", 2), ("k > 49 and k < 12", 0), ("k = 31", 1), ("k in (0, 1, 59)", 2), ("k <= 5", 2), ("s = 's003'", 1), ("s is null", 3),
        ("s is not null", 9), ("k < 10 or k > 50", 12), ("t < timestamp_ntz '2024-01-01 05:00:00'", None), ("s >= 's05'", None), ("k is null", 0), ("k <=> 7", None),
    ],
)
def test_filters_leave_out_segments_and_no_rows(source, tmp_path, condition, segments):
    fill(tmp_path)
    rows = source.read.format("segments").load(str(tmp_path)).where(condition)
    plain = source.read.parquet(str(tmp_path)).where(condition)
    assert sorted(map(str, rows.drop("segment").collect())) == sorted(map(str, plain.collect()))
    if segments is not None:
        assert rows.rdd.getNumPartitions() == max(1, segments)  # a task of none where nothing is left


def test_each_condition_has_a_table_of_its_own(source, tmp_path):
    n = fill(tmp_path)
    few, all_rows = segment_rows(source, str(tmp_path), "k < 5"), segment_rows(source, str(tmp_path))
    assert (few.count(), all_rows.count(), few.union(all_rows).count()) == (5, n, n + 5)


def test_rows_carry_their_segment(source, tmp_path):
    n = fill(tmp_path)
    rows = source.read.format("segments").load(f"file://{tmp_path}")
    assert rows.columns == ["k", "s", "t", "segment"] and rows.count() == n
    assert {(r.k // 5, r.segment) for r in rows.collect()} == {(i, i) for i in range(12)}
    only = source.read.format("segments").load(str(tmp_path / "part-1.parquet"))
    assert sorted(r.k for r in only.collect()) == list(range(20, 40))


def test_streams_take_segments_in_batches(source, tmp_path):
    data, out = tmp_path / "in", tmp_path / "out"
    data.mkdir()
    n = fill(data)
    seen = []

    def run(per_batch):
        stream = source.readStream.format("segments").option("segmentsPerBatch", per_batch).load(str(data))
        q = stream.writeStream.foreachBatch(lambda df, i: seen.append((i, sorted(r.k for r in df.collect())))).option("checkpointLocation", str(out)).start()
        q.processAllAvailable()
        q.stop()

    run(5)
    assert [len(k) for _, k in seen] == [25, 25, 10] and sorted(x for _, k in seen for x in k) == list(range(n))
    with pq.ParquetWriter(data / "part-9.parquet", pa.schema([("k", pa.int64()), ("s", pa.string()), ("t", pa.timestamp("us"))])) as w:
        w.write_table(pa.table([[1000], ["x"], [dt.datetime(2024, 1, 1)]], schema=w.schema))
    run(5)  # goes on after the segments that are done
    assert [k for _, k in seen[3:] if k] == [[1000]]


def test_what_is_wrong_is_said(source, tmp_path):
    with pytest.raises(Exception, match="no files"):
        source.read.format("segments").load(str(tmp_path)).count()
    with pytest.raises(Exception, match="path"):
        source.read.format("segments").load().count()

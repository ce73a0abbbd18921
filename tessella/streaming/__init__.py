"""Structured Streaming: file sources, event-time operators and keyed state."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessella.sources.scratch import scratch

#: Files of a batch of a replay.
MOST_FILES = 16
#: Buckets that keys are held in as state: fixed, as a stream's partitions are.
BUCKETS = 1024


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """The table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _files(spark: SparkSession, path: str) -> int:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*")
    return len(jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm_path) or [])


def replayed(parts: Sequence[DataFrame], name: str) -> DataFrame:
    """A stream that brings the rows of each part in a batch of its own, in this order.

    A part is written by several tasks. A batch takes a fixed number of files, so a part
    of fewer gets empty ones.
    """
    spark, path = parts[0].sparkSession, scratch(parts[0].sparkSession, name)
    files, empty = min(MOST_FILES, max(part.rdd.getNumPartitions() for part in parts)), spark.createDataFrame([], parts[0].schema).coalesce(1)
    for i, part in enumerate(parts):  # a file source takes files by their time, which may be kept in whole seconds
        time.sleep(1.1 if i else 0)
        part.coalesce(files).write.mode("append").parquet(path)
        for _ in range((i + 1) * files - _files(spark, path)):
            empty.write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(path)


def with_event_time(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """The stream with `column` as a zoned timestamp, which watermarks need, and a watermark on it."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def drained(stream: DataFrame, name: str, ends: bool = True) -> DataFrame:
    """All that the stream gives for what is there now, through a file sink, which writes each row exactly once.

    `ends` is for sources that tell what is there when a query starts; others, such as
    those written in Python, are asked again after each batch until nothing new comes.
    """
    spark = stream.sparkSession
    out, state = scratch(spark, name), scratch(spark, f"{name}-state")
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state)
    query = (writer.trigger(availableNow=True) if ends else writer).start(out)
    if ends:
        query.awaitTermination()
    else:
        query.processAllAvailable()
        query.stop()
    return spark.read.schema(stream.schema).parquet(out)


def tumbling_counts(stream: DataFrame, time: str, width: str, *keys: str) -> DataFrame:
    w = F.window(time, width)
    return stream.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sliding_counts(stream: DataFrame, time: str, width: str, step: str) -> DataFrame:
    return stream.groupBy(F.window(time, width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def session_counts(stream: DataFrame, time: str, gap: str, key: str) -> DataFrame:
    grouped = stream.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), "n")


def _in_buckets(stream: DataFrame, key: str, at: str, buckets: int) -> DataFrame:
    """The stream with __bucket, -1 for null keys only, and __at in microseconds; pandas keeps whole numbers whole only where none is null."""
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")
    whole = stream.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    made = stream.withColumns({"__bucket": bucket, "__at": F.unix_micros(F.col(at).cast("timestamp"))}).where("__at is not null")
    return made.withColumn(key, F.coalesce(key, F.lit(0))) if whole else made


def running_totals(stream: DataFrame, key: str, value: str, at: str, idle: str, buckets: int = BUCKETS) -> DataFrame:
    """Per key and batch: the number of events and the sum of values since `since`, in keyed state that ends.

    `stream` has a watermark on `at`. When the watermark is `idle` (such as "7 days") past
    a key's last event, its state goes; a later event begins new totals, with a `since` of
    its own. So state holds the keys of the last days, and the totals of a key are the last
    of each `since`, added up. Keys are held by bucket, as a call of Python for each costs
    more than its rows. Rows without a time are left out.
    """
    pause = int(pd.Timedelta(idle).total_seconds() * 1000)
    names = ["since", "last", "n", "total"]

    def update(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(state.get[0], zip(*state.get[1:], strict=True), strict=True)) if state.exists else {}
        fresh = set()
        for frame in () if state.hasTimedOut else frames:
            by = pd.Series([None] * len(frame), dtype=object) if bucket[0] == -1 else frame[key].reset_index(drop=True)
            rows = pd.DataFrame({"k": by, "at": (frame["__at"] // 1000).to_numpy(), "v": frame[value].to_numpy()}).groupby("k", dropna=False, sort=False)
            found = rows.agg(since=("at", "min"), last=("at", "max"), n=("at", "size"), total=("v", "sum"))
            keys = [None] if bucket[0] == -1 else found.index.tolist()
            for k, since, last, n, total in zip(keys, *(found[c].tolist() for c in names), strict=True):
                before = held.get(k)
                held[k] = (since, last, n, float(total)) if before is None else (before[0], max(before[1], last), before[2] + n, before[3] + total)
                fresh.add(k)
        now = state.getCurrentWatermarkMs()
        out = [(k, held[k][0], held[k][2], held[k][3]) for k in fresh]
        held = {k: x for k, x in held.items() if k in fresh or x[1] + pause > now}
        if held:
            state.update((list(held), *map(list, zip(*held.values(), strict=True))))
            state.setTimeoutTimestamp(max(min(x[1] for x in held.values()) + pause, now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[key, "since", "n", "total"])

    kind = stream.schema[key].dataType.simpleString()
    timed = _in_buckets(stream, key, at, buckets).groupBy("__bucket")
    held = f"keys array<{kind}>, since array<long>, last array<long>, n array<long>, total array<double>"
    return timed.applyInPandasWithState(update, f"{key} {kind}, since long, n long, total double", held, "append", GroupStateTimeout.EventTimeTimeout)


def first_of_window(stream: DataFrame, time: str, width: str, *keys: str) -> DataFrame:
    """(start, keys): each combination of keys once a window, as soon as it comes. State goes when the watermark has passed its window."""
    w = stream.withColumn("w", F.window(time, width)).select("w", *keys).dropDuplicates(["w", *keys])
    return w.select(F.col("w.start").alias("start"), *keys)


def visit_starts(stream: DataFrame, by: str, at: str, gap: pd.Timedelta, buckets: int = BUCKETS) -> DataFrame:
    """(by, start): the first event of each visit, which is over when `gap` goes by without another.

    The state of a key is the time of its last event, and goes with a timer when the
    watermark has passed the end of the visit. Events of one batch may come in any order,
    batches come in order of time. Keys are held by bucket, each with one timer, as every
    question to the state store costs more than a key's rows. Rows without a time are left out.
    """
    kind, stamp = stream.schema[by].dataType.simpleString(), stream.schema[at].dataType
    pause = int(gap.total_seconds() * 1_000_000)

    class Visits(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", f"keys array<{kind}>, last array<long>")

        def _held(self) -> dict:
            return dict(zip(*self.last.get(), strict=True)) if self.last.exists() else {}

        def _keep(self, held: dict, now: int) -> None:
            held = {k: x for k, x in held.items() if (x + pause) // 1000 > now}
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if held:
                self.last.update((list(held), list(held.values())))
                self.handle.registerTimer(max((min(held.values()) + pause) // 1000, now + 1))
            else:
                self.last.clear()

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            frame = pd.concat([f[["key_", "micros_"]] for f in rows]).sort_values("micros_", kind="stable", ignore_index=True)
            code, keys = ([0] * len(frame), [None]) if key[0] == -1 else pd.factorize(frame["key_"], use_na_sentinel=False)
            keys, held = keys if key[0] == -1 else keys.tolist(), self._held()
            before = frame["micros_"].groupby(code).shift()
            known = pd.Series([held.get(k) for k in keys], dtype="float64")
            times = frame["micros_"]
            first = before.isna()
            before[first] = known.reindex(pd.Series(code)[first]).to_numpy()
            fresh = before.isna() | (times - before >= pause)
            held |= {keys[c]: max(x, held.get(keys[c], x)) for c, x in times.groupby(code).max().items()}
            self._keep(held, timerValues.getCurrentWatermarkInMs())
            at_start = pd.Series(code)[fresh].tolist()
            yield pd.DataFrame({by: pd.Series([keys[c] for c in at_start], dtype=object), "start": times[fresh].to_numpy()})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            self._keep(self._held(), timerValues.getCurrentWatermarkInMs())
            yield pd.DataFrame({by: pd.Series([], dtype=object), "start": pd.Series([], dtype="int64")})

        def close(self) -> None:
            pass

    named = {"__bucket": "bucket_", by: "key_", "__at": "micros_"}  # names that begin with _ don't reach these frames
    timed = _in_buckets(stream, by, at, buckets).select(at, *[F.col(c).alias(n) for c, n in named.items()]).groupBy("bucket_")
    starts = timed.transformWithStateInPandas(Visits(), f"{by} {kind}, start long", "append", "EventTime")
    return starts.select(by, F.timestamp_micros("start").cast(stamp).alias("start"))


class UpsertTable:
    """A table of the latest row of each key, which streams write batch by batch and may write again.

    Every batch is a folder of its own, named by its number and replaced as a whole: a
    batch that was written but not committed, and comes again after a restart, takes the
    place of what it wrote. Readers see folders whose write has ended, and take of each
    key the row of the greatest `order`, of equal ones that of the later batch. Rows with
    `gone` true delete their key. A batch holds its latest row a key, so hot keys combine
    before the shuffle; `compact` puts the batches up to a number together, so that reading
    costs the table and few batches. Null keys are a key; rows with a null order come before all.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: str) -> None:
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), list(keys), order
        self.schema = spark.createDataFrame([], schema).withColumn("gone", F.lit(False)).select(*spark.createDataFrame([], schema).columns, "gone").schema

    def _folders(self, kind: str) -> list[int]:
        """Numbers of the folders whose write has ended."""
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = system.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}-*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName().removeprefix(f"{kind}-")) for f in found)

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row a key, of those with `__batch`."""
        last = F.max_by(F.struct(*self.schema.names), F.struct(F.col(self.order).isNotNull(), F.col(self.order), "__batch"))
        keyed = rows.groupBy(F.struct(*self.keys).alias("__key")).agg(last.alias("__row"))
        return keyed.select("__row.*")

    def write(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: writes the batch with this number, for the first time or again."""
        rows = batch if "gone" in batch.columns else batch.withColumn("gone", F.lit(False))
        rows = rows.select(*self.schema.names).withColumn("__batch", F.lit(number))
        self._latest(rows).write.mode("overwrite").parquet(f"{self.path}/batch-{number:012d}")

    def _rows(self, upto: int | None = None) -> DataFrame:
        bases = [b for b in self._folders("base") if upto is None or b <= upto]
        base = bases[-1] if bases else -1
        parts = [(b, f"batch-{b:012d}") for b in self._folders("batch") if b > base and (upto is None or b <= upto)]
        parts = ([(base, f"base-{base:012d}")] if bases else []) + parts
        rows = self.spark.createDataFrame([], self.schema).withColumn("__batch", F.lit(0))
        for number, name in parts:
            rows = rows.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}").withColumn("__batch", F.lit(number)))
        return self._latest(rows)

    def read(self, upto: int | None = None) -> DataFrame:
        """The table after all batches, or after the one of this number."""
        return self._rows(upto).where("not gone").drop("gone")

    def compact(self, upto: int) -> None:
        """Puts the batches up to a number that has been committed together; deleted keys stay marked, as older batches may come later."""
        self._rows(upto).write.mode("overwrite").parquet(f"{self.path}/base-{upto:012d}")

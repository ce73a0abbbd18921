"""What several operators share: the shared folder, written intermediate tables, distributed numbering."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Words as the contracts count them: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; on a cluster that is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
        named = context.getCheckpointDir()
    return named


class _Scopes(threading.local):
    """Tables stashed within each open `scope` of a thread, the innermost last."""

    def __init__(self) -> None:
        self.open: list[list[DataFrame]] = []


_scopes = _Scopes()


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread stashes inside are deleted at its end: whatever is read later has to be stashed by then with `keep`."""
    _scopes.open.append([])
    try:
        yield
    finally:
        discard(*_scopes.open.pop())


#: Rows of one batch between Spark and Python while a table is stashed: of long texts, Spark's own number makes batches of tens of MB, of which a task holds several.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class _ShortBatches:
    """Sets the rows of a batch while any thread is inside, and sets them back when the last one leaves."""

    def __init__(self) -> None:
        self.lock, self.inside, self.before = threading.Lock(), 0, ""

    @contextmanager
    def __call__(self, spark: SparkSession) -> Iterator[None]:
        with self.lock:
            if self.inside == 0:
                self.before = spark.conf.get(_BATCH)
                if not 0 < int(self.before) <= BATCH_ROWS:
                    spark.conf.set(_BATCH, str(BATCH_ROWS))
            self.inside += 1
        try:
            yield
        finally:
            with self.lock:
                self.inside -= 1
                if self.inside == 0:
                    spark.conf.set(_BATCH, self.before)


_short_batches = _ShortBatches()


def stash(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write `df` once as parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that it ran, never the
    steps before, and steps that read the table twice see the same rows. The files go at
    the end of the `scope` that it stands in (with `keep`, of the one around that), else
    when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _short_batches(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stashed = path
    inside = _scopes.open[:-1] if keep else _scopes.open
    if inside:
        inside[-1].append(back)
    else:
        atexit.register(_remove, spark, path)
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes the files of stashed tables. Only for those whose every reader has been stashed itself."""
    for df in tables:
        _remove(df.sparkSession, df._stashed)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the session has gone: the shared folder's owner cleans up
        pass


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def number_rows(df: DataFrame, group: list[str], chunk: Column, order: list[Column], out: str) -> DataFrame:
    """Gapless 0-based numbers within each group, without bringing a group together.

    `chunk` splits every group into pieces of bounded size. Rows are numbered inside
    (group, chunk); only the counts of the chunks are summed up over a whole group.
    The order is that of (chunk, order).
    """
    c = "__chunk"
    df = df.withColumn(c, chunk)
    before = W.partitionBy(*group).orderBy(c).rowsBetween(W.unboundedPreceding, -1)
    base = (
        df.groupBy(*group, c)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*group, c, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    )
    inside = W.partitionBy(*group, c).orderBy(*order)
    return (
        df.join(base, [*group, c])
        .withColumn(out, (F.row_number().over(inside) - 1 + F.col("__base")).cast("long"))
        .drop(c, "__base")
    )


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], rows_per_chunk: int = 50_000) -> DataFrame:
    """Adds to every row the sums over all rows before it in `order`, without bringing the table together.

    The table is written in ranges of the order, of `rows_per_chunk` rows or so; only the
    ranges' own sums are added up in one place. One range is one window. `order` has to
    tell rows apart; an empty table stays empty.
    """
    chunk, zero, parts = "__chunk", F.lit(0), chunks_for(df.count(), rows_per_chunk, 1)
    if parts == 1:
        all_before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumns({k: F.coalesce(F.sum(c).over(all_before), zero) for k, c in sums.items()})
    ranged = stash(df.repartitionByRange(parts, *order).withColumn(chunk, F.spark_partition_id()), "in-order")
    before = W.orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)  # a row a range
    base = ranged.groupBy(chunk).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    base = base.select(chunk, *[F.coalesce(F.sum(k).over(before), zero).alias(f"__base_{k}") for k in sums])
    inside = W.partitionBy(chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = ranged.join(base, chunk).withColumns({k: F.coalesce(F.sum(c).over(inside), zero) + F.col(f"__base_{k}") for k, c in sums.items()})
    return rows.drop(chunk, *[f"__base_{k}" for k in sums])


def chunks_for(n_rows: int, rows_per_chunk: int = 4000, least: int = 16, most: int = 1 << 20) -> int:
    """So many chunks that one holds a few thousand rows; the bound keeps the table of chunks small."""
    return max(least, min(most, -(-n_rows // rows_per_chunk)))


def salted(n_chunks: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n_chunks)).cast("int")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that a task holds few texts as Python objects at once."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, unless PYTHONPATH already leads their Python to it."""
    root = Path(__file__).resolve().parents[2]
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    context = spark.sparkContext
    if root in on_path or getattr(context, "_tessella_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tessella-")  # Spark's file server on the driver reads it as long as executors may ask
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, "tessella.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.joinpath("tessella").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(archive))
    context._tessella_shipped = True

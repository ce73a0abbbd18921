"""Reading and writing tables in Spark's file formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "json", "csv")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None, **options: str) -> DataFrame:
    """A table of one of FORMATS. Text formats need a schema: inferring one would read the input twice."""
    if fmt not in FORMATS:
        raise ValueError(f"{fmt!r} is none of {FORMATS}")
    if fmt in ("json", "csv") and schema is None:
        raise ValueError(f"{fmt} is read with a schema only")
    reader = spark.read.format(fmt).options(**({"header": "true"} | options if fmt == "csv" else options))
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "error", **options: str) -> None:
    """Writes a table; with `partition_by`, rows of one partition value go to few files.

    Rows are rebalanced by those columns: adaptive execution splits the tasks of values
    that hold much of the table, and joins those of small ones.
    """
    if fmt not in FORMATS:
        raise ValueError(f"{fmt!r} is none of {FORMATS}")
    if partition_by:
        df = rebalanced(df, partition_by)
    writer = df.write.format(fmt).mode(mode).options(**({"header": "true"} | options if fmt == "csv" else options))
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def rebalanced(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of equal `by` in as few tasks as their size allows. Only SQL can say this by columns."""
    names = ", ".join(f"`{c}`" for c in by)
    return df.sparkSession.sql(f"SELECT /*+ REBALANCE({names}) */ * FROM {{rows}}", rows=df)


def buckets_for(rows: int, rows_per_bucket: int = 2_000_000, least: int = 8) -> int:
    return max(least, -(-rows // rows_per_bucket))


def write_bucketed(df: DataFrame, name: str, buckets: int, keys: Sequence[str], path: str | None = None) -> None:
    """A table of the catalog, bucketed and sorted by keys, so that joins on them need no shuffle.

    `path` is where its files stand; without one they go to the warehouse folder, which on
    a cluster has to be a shared one. Each bucket is one file.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(name)

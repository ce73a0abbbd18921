"""A folder that driver and executors share, for tables written on the way."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir.

    Where that is unset, a local session gets a folder of its own; on a cluster, whose
    machines would each write to their own disk, that is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
        base = context.getCheckpointDir()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, read back: it is computed once, whoever reads it and however often.

    A lost executor then costs the tasks that it ran and none of the steps before. The
    files go when the driver's Python ends, as lazy results may read them until then.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder; without a live session nothing happens, and the folder's owner cleans up."""
    if spark.sparkContext._jsc is None:
        return
    with contextlib.suppress(Exception):  # the JVM may have gone before Python
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)

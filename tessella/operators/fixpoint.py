"""Recursion over tables: rows that follow from rows, round by round, until nothing new comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.scratch import remove, scratch


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], round_name: str = "round", most_rounds: int = 1000, compact_every: int = 10) -> DataFrame:
    """The distinct rows of `start` and all that `step` makes of them, of what it makes of these, and so on, with the round that each came in first.

    Each round applies `step` to the rows that the round before brought (semi-naive: no
    row is expanded twice) and keeps those not seen yet. `step` gives the columns of
    `start`, and is monotone: what it makes of a row doesn't depend on the others. A round
    writes its new rows to the shared folder, so a lost executor never reaches back over
    a round, and plans don't grow; seen rows are put together every `compact_every`
    rounds, so that a round reads few files however many went before. The driver sees
    one count a round. Null values are values; after `most_rounds` without an end it is
    an error.
    """
    spark, columns = start.sparkSession, start.columns
    parts: list[str] = []

    def put(rows: DataFrame, name: str) -> str:
        path = scratch(spark, f"fixpoint-{name}")
        rows.write.parquet(path)
        return path

    schema = start.select(*columns, F.lit(0).cast("long").alias(round_name)).schema
    held = lambda paths: spark.read.schema(schema).parquet(*paths)
    parts.append(put(start.distinct().withColumn(round_name, F.lit(0).cast("long")), "start"))
    for number in range(1, most_rounds + 1):
        new = step(held(parts[-1:]).select(*columns)).select(*columns).distinct()
        seen = held(parts).select(*[F.col(c).alias(f"__seen_{c}") for c in columns])
        same = [F.col(c).eqNullSafe(F.col(f"__seen_{c}")) for c in columns]
        parts.append(put(new.join(seen, same, "left_anti").withColumn(round_name, F.lit(number).cast("long")), f"round-{number}"))
        if held(parts[-1:]).isEmpty():
            return held(parts)
        if len(parts) > compact_every:
            old = parts[:-1]
            parts = [put(held(old), "compacted"), parts[-1]]
            for path in old:
                remove(spark, path)
    raise RuntimeError(f"no end after {most_rounds} rounds")


def reachable(edges: DataFrame, source: str, target: str, start: DataFrame, **options: int) -> DataFrame:
    """(node, hops): every node that edges lead to from the nodes of `start` (one column), these included, with the least number of edges.

    Edges with a null end lead nowhere; a null start is no node. A node that has much of
    all edges is one key of a join whose partitions Spark splits where they are skewed.
    """
    lead = edges.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(source).alias("node"), F.col(target).alias("__to"))
    first = start.toDF("node").where("node is not null")
    return fixpoint(first, lambda new: new.join(lead, "node").select(F.col("__to").alias("node")), "hops", **options)

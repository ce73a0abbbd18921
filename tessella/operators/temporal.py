"""Joins and groupings by time, ranges and order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.operators.ordered import ROWS, running


def as_of_join(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, values: Sequence[str], prefix: str = "as_of_", rows: int = ROWS) -> DataFrame:
    """Every row of `left` with the latest row of `right` of the same key at or before its time.

    Both sides stand in one order of key and time, which is cut into ranges; the last row
    of `right` is carried on within a range and from range to range. Nothing is joined pair
    by pair, and a key of any size costs no more than its rows. Of several right rows of
    one time, that of the greatest values counts. Rows without an earlier match get nulls,
    and so do rows with a null in the key or time: like in any join, null equals nothing.
    """
    names = [time, *values]
    keyed = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*by, time)])
    held = right.where(keyed).select(*by, time, F.lit(0).alias("__side"), F.struct(*names).alias("__packed"))
    nothing = F.lit(None).cast(held.schema["__packed"].dataType)
    asks = left.withColumn("__side", F.lit(1)).withColumn("__packed", nothing)
    both = asks.where(keyed).unionByName(held, allowMissingColumns=True)
    met = running(both, by, [time, "__side", "__packed"], lasts={"__found": F.col("__packed")}, rows=rows).where("__side = 1")
    met = met.unionByName(asks.where(~keyed).withColumn("__found", nothing))
    return met.select(*left.columns, *[F.col(f"__found.{c}").alias(f"{prefix}{c}") for c in names])


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges [low, high) that hold them, as an equality join on cells.

    A range stands in cells of the least of the widths `width`, 2 `width`, 4 `width`, ...
    that is as long as it, of which it meets two at most; a point asks for its cell of
    each width that ranges have. So a range of any length is copied once at most, and the
    points once for each of few widths. Nulls, and ranges that are empty, meet nothing.
    """
    level, cell = "__level", "__cell"
    span = (F.col(high) - F.col(low)) / width
    fits = F.when(span > 1, F.least(F.ceil(F.log2(span)), F.lit(1000))).otherwise(0).cast("int")
    held = ranges.where(F.col(low) < F.col(high)).withColumn(level, fits)
    of = lambda c, lev: F.floor(F.col(c) / (F.pow(F.lit(2.0), lev) * width))
    held = held.withColumn(cell, F.explode(F.array_distinct(F.array(of(low, F.col(level)), of(high, F.col(level))))))
    levels = [r[level] for r in held.select(level).distinct().collect()]  # a few dozen at most
    asks = F.array(*[F.struct(F.lit(i).alias("level"), of(point, F.lit(i)).alias("cell")) for i in sorted(levels)]) if levels else F.array().cast("array<struct<level:int,cell:bigint>>")
    p = points.withColumn("__at", F.explode(asks)).withColumns({level: F.col("__at.level"), cell: F.col("__at.cell")}).drop("__at")
    return p.join(held, [level, cell]).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop(level, cell)


def dominance_counts(df: DataFrame, by: Sequence[str], key: str, greater: str, less: str, out: str, rows: int = ROWS) -> DataFrame:
    """(key, out): for each row, how many of its `by` have a greater `greater` and a lesser `less`, a whole number from 0 up.

    The join on both inequalities, counted without its pairs: every row stands in a node
    of each level of a binary tree over `less`, asks the few nodes that make up all lesser
    values, and a running sum in falling order of `greater` counts what stands above, in
    ranges where a node is large. So n rows cost n times the bits of `less`, not n squared.
    Keys are unique; rows with nulls in `by`, `greater` or `less` and rows that count
    nothing are left out.
    """
    top = df.agg(F.max(less)).first()[0]  # one number: the depth of the tree
    bits = max(1, int(top or 0).bit_length())
    points = df.select(*by, key, F.col(greater).alias("__x"), F.col(less).cast("long").alias("__y"))
    points = points.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*by, "__x", "__y")]))
    node = lambda level: F.shiftright("__y", level)
    stands = points.select(*by, "__x", F.explode(F.array(*[F.struct(F.lit(i).alias("level"), node(i).alias("node")) for i in range(bits)])).alias("at"), F.lit(1).alias("__one"), F.lit(None).cast(df.schema[key].dataType).alias(key))
    lesser = F.array_compact(F.array(*[F.when(node(i).bitwiseAND(F.lit(1)) == 1, F.struct(F.lit(i).alias("level"), (node(i) - 1).alias("node"))) for i in range(bits)]))
    asks = points.select(*by, "__x", F.explode(lesser).alias("at"), F.lit(0).alias("__one"), key)
    seen = running(stands.unionByName(asks), [*by, "at"], ["__x desc", "__one"], sums={"__n": F.col("__one")}, rows=rows)
    return seen.where("__one = 0").groupBy(key).agg(F.sum("__n").alias(out)).where(F.col(out) > 0)


def sessions(df: DataFrame, by: str, time: str, gap: str, *aggregates: Column) -> DataFrame:
    """One row per session of a key: start, end (last event plus the gap) and the aggregates."""
    grouped = df.groupBy(by, F.session_window(time, gap).alias("w")).agg(*aggregates)
    return grouped.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in grouped.columns if c not in (by, "w")])


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n rows per group and task before it shuffles."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def salted_sum(df: DataFrame, by: Sequence[str], value: str, salts: int, out: str) -> DataFrame:
    """A sum in two steps, for keys that hold much of the table and aggregates that don't combine before the shuffle."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    return salted.groupBy(*by, "__salt").agg(F.sum(value).alias("__s")).groupBy(*by).agg(F.sum("__s").alias(out))

"""Exact quantiles without bringing a group together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float], cells: int = 256) -> DataFrame:
    """One row per group: its keys and the interpolated quantiles of `value`, by output name.

    A sketch cuts each group's values into cells; counts of the cells, which combine before
    the shuffle, say in which cells the wanted ranks lie; only these cells' distinct values
    are ordered. So a group of any size, and a value that much of it has, cost a pass and a
    cell. Null values don't count; groups of nulls only are left out; null keys are a group.
    """
    keys, amount = F.struct(*by).alias("__by"), F.col(value).cast("double").alias("__v")
    rows = df.where(F.col(value).isNotNull()).select(keys, amount)
    edges = rows.groupBy("__by").agg(F.percentile_approx("__v", [i / cells for i in range(1, cells)], 100 * cells).alias("__edges"), F.count(F.lit(1)).alias("__n"))
    celled = rows.join(edges, "__by").select("__by", "__v", F.size(F.filter("__edges", lambda e: e < F.col("__v"))).alias("__cell"), "__n")
    counts = celled.groupBy("__by", "__cell", "__n").agg(F.count(F.lit(1)).alias("__k"))
    before = F.coalesce(F.sum("__k").over(W.partitionBy("__by").orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = [F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("__n") - 1)).alias("at")) for name, p in quantiles.items()]
    hits = counts.withColumn("__before", before).withColumn("__q", F.explode(F.array(*places)))
    hits = hits.withColumn("__rank", F.explode(F.array_distinct(F.array(F.floor("__q.at"), F.ceil("__q.at")))))
    hits = hits.where("__rank >= __before and __rank < __before + __k").select("__by", "__cell", "__before", "__q", "__rank")
    values = celled.join(hits.select("__by", "__cell").distinct(), ["__by", "__cell"], "left_semi").groupBy("__by", "__cell", "__v").agg(F.count(F.lit(1)).alias("__m"))
    upto = F.sum("__m").over(W.partitionBy("__by", "__cell").orderBy("__v"))
    found = values.withColumn("__upto", upto).join(hits, ["__by", "__cell"])
    found = found.where("__rank >= __before + __upto - __m and __rank < __before + __upto")
    low, high, part = F.min("__v"), F.max("__v"), F.first(F.col("__q.at") - F.floor("__q.at"))
    each = found.groupBy("__by", F.col("__q.name").alias("__name")).agg((low + (high - low) * part).alias("__value"))
    wide = each.groupBy("__by").agg(*[F.max(F.when(F.col("__name") == name, F.col("__value"))).alias(name) for name in quantiles])
    return wide.select("__by.*", *quantiles)

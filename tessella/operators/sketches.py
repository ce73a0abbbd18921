"""Sketches kept as columns: made once per key and period, merged later to any longer period or combination, without the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes: relative standard error of distinct counts about 1 / sqrt(2^LOG_ENTRIES); rank error of quantiles about 1.3 % for 200.
LOG_ENTRIES = 12
QUANTILE_SIZE = 200


def sketched(df: DataFrame, by: Sequence[str | Column], member: str, value: str) -> DataFrame:
    """(by, n, members, approx_members, values): of each group its rows, a theta and an HLL sketch of `member` and a KLL sketch of `value`.

    Sketches combine in each task before the shuffle and have a bounded size, so they can be
    stored, a row a group, in place of the rows. Null members and values count for nothing.
    """
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.theta_sketch_agg(member, LOG_ENTRIES).alias("members"),
        F.hll_sketch_agg(member, LOG_ENTRIES).alias("approx_members"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILE_SIZE).alias("values"),
    )


def merged(sketches: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """The same columns for longer periods or fewer keys, from sketches alone."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.theta_union_agg("members", LOG_ENTRIES).alias("members"),
        F.hll_union_agg("approx_members").alias("approx_members"),
        F.kll_merge_agg_double("values", QUANTILE_SIZE).alias("values"),
    )


def estimates(sketches: DataFrame, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """Distinct members by both sketches, and an array of quantiles of the values, null where there are none."""
    at = F.kll_sketch_get_quantile_double("values", F.array(*[F.lit(float(q)) for q in quantiles]))
    others = [c for c in sketches.columns if c not in ("members", "approx_members", "values")]
    held = F.kll_sketch_get_n_double("values") > 0
    return sketches.select(*others, F.theta_sketch_estimate("members").alias("distinct"), F.hll_sketch_estimate("approx_members").alias("approx_distinct"), F.when(held, at).alias("quantiles"))


def in_both(a: Column, b: Column) -> Column:
    """About how many members two theta sketches have in common."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))

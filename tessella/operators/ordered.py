"""Running values and ranks over keys of any size, up to one key for the whole table.

A window holds all rows of a key in one task. Here the table is cut into ranges of
(key, order) that a sample makes about equal, windows run inside a range, and what a
range starts with is carried over from the ranges before: a row a range, however large
the key. Null keys are a key, as in windows. Columns whose names start with `__` are
reserved.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.sources.scratch import written

ROWS = 200_000
LEAST = 8

_BY, _RANGE, _ROW = "__by", "__range", "__row"


def columns_of(order: Sequence[str]) -> list[Column]:
    return [F.desc(c.removesuffix(" desc")) if c.endswith(" desc") else F.asc(c) for c in order]


def in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str], rows: int = ROWS, unique: bool = False) -> DataFrame:
    """The table with __by, __row and __range, a number that rises with (by, order); a range has about `rows` rows.

    Rows that tie in all of it are told apart by their place in a copy written first, so
    that ties of any number are spread as well; with `unique`, (by, order) tells rows
    apart already and that copy is left out.
    """
    key = F.struct(*by).alias(_BY) if by else F.struct(F.lit(0).alias("all")).alias(_BY)
    source = df if unique else written(df, "rows")
    placed = source.select("*", key, (F.lit(0).cast("long") if unique else F.monotonically_increasing_id()).alias(_ROW))
    parts = max(LEAST, -(-placed.count() // rows))
    ranged = placed.repartitionByRange(parts, F.col(_BY), *columns_of(order), F.col(_ROW))
    return written(ranged.withColumn(_RANGE, F.spark_partition_id()), "ranges")


def _together(ranged: DataFrame) -> DataFrame:
    """Each range in one task, in as many tasks as there are ranges twice over: what a task holds is that of a few ranges, however large the table."""
    ranges = (ranged.agg(F.max(_RANGE)).first()[0] or 0) + 1
    return ranged.repartition(max(LEAST, 2 * ranges), _RANGE)


def _inside(order: Sequence[str]) -> W:
    return W.partitionBy(_RANGE, _BY).orderBy(*columns_of(order), _ROW)


def _carry(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """Rows with what their key brings from other ranges; nulls for keys that stand in one range only. `carried` has two rows a range at most, so it goes to all tasks."""
    carried = carried.withColumnsRenamed({_RANGE: "__r", _BY: "__b"})
    return rows.join(F.broadcast(carried), (F.col(_RANGE) == F.col("__r")) & F.col(_BY).eqNullSafe(F.col("__b")), "left").drop("__r", "__b")


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] = {}, lasts: Mapping[str, Column] = {}, rows: int = ROWS, unique: bool = False, nexts: Mapping[str, Column] = {}) -> DataFrame:
    """Adds running sums, up to and with each row, the last values that aren't null up to it, and the `nexts` that aren't null after it, of the row's key in `order`.

    Sums of nulls only are null, as in a window. The order of rows that tie in `order` is
    the same for all columns.
    """
    upto = _inside(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    columns = {k: F.sum(c).over(upto) for k, c in sums.items()} | {k: F.last(c, ignorenulls=True).over(upto) for k, c in lasts.items()}
    back = W.partitionBy(_RANGE, _BY).orderBy(*columns_of([c.removesuffix(" desc") if c.endswith(" desc") else f"{c} desc" for c in order]), F.desc(_ROW))
    after = {k: F.last(c, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1)) for k, c in nexts.items()}
    first = {f"__first_{k}": F.last(c, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, W.currentRow)) for k, c in nexts.items()}
    size, number = F.count(F.lit(1)).over(W.partitionBy(_RANGE, _BY)), F.row_number().over(_inside(order))
    inner = _together(in_ranges(df, by, order, rows, unique)).withColumns(columns | after | first | {"__size": size, "__number": number})
    along = W.partitionBy(_BY).orderBy(_RANGE)
    before = along.rowsBetween(W.unboundedPreceding, -1)
    bases = {k: F.sum(k).over(before) for k in sums} | {k: F.last(k, ignorenulls=True).over(before) for k in lasts}
    bases |= {k: F.last(f"__first_{k}", ignorenulls=True).over(W.partitionBy(_BY).orderBy(F.desc(_RANGE)).rowsBetween(W.unboundedPreceding, -1)) for k in nexts}
    ends = inner.where("__number = __size").select(_RANGE, _BY, *columns)
    if nexts:
        edge = lambda at, k: F.first(F.when(F.col("__number") == at, F.col(k)), ignorenulls=True).alias(k)
        edges = inner.where("__number = __size or __number = 1").groupBy(_RANGE, _BY)
        ends = edges.agg(*[edge(F.col("__size"), k) for k in columns], *[edge(1, k) for k in first])
    ends = ends.select(_RANGE, _BY, *[c.alias(f"__base_{k}") for k, c in bases.items()], F.count(F.lit(1)).over(W.partitionBy(_BY)).alias("__ranges"))
    met = _carry(inner.drop("__size", "__number", *first), ends.where("__ranges > 1").drop("__ranges"))
    whole = {k: F.coalesce(F.col(k) + F.col(f"__base_{k}"), F.col(k), F.col(f"__base_{k}")) for k in sums} | {k: F.coalesce(F.col(k), F.col(f"__base_{k}")) for k in [*lasts, *nexts]}
    return met.withColumns(whole).drop(_RANGE, _BY, _ROW, *[f"__base_{k}" for k in [*columns, *nexts]])


def ranks(df: DataFrame, by: Sequence[str], order: Sequence[str], out: Mapping[str, str | tuple[str, int]], rows: int = ROWS, unique: bool = False) -> DataFrame:
    """Adds ranks of each row within its key: `out` names a column each for "row_number", "rank", "dense_rank", "percent_rank", "cume_dist" or ("ntile", n).

    They are those of the window functions of these names. Ties may reach over any number
    of ranges: a range knows where the tie that it starts with began, and where the one
    that it ends with ends.
    """
    kinds = {k: v if isinstance(v, str) else v[0] for k, v in out.items()}
    if unknown := set(kinds.values()) - {"row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile"}:
        raise ValueError(f"no ranks: {sorted(unknown)}")
    ranged = _together(in_ranges(df, by, order, rows, unique))
    value = F.struct(*[F.col(c.removesuffix(" desc")).alias(f"v{i}") for i, c in enumerate(order)])
    ties = W.partitionBy(_RANGE, _BY).orderBy(*columns_of(order))
    own = {
        "__value": value,
        "__size": F.count(F.lit(1)).over(W.partitionBy(_RANGE, _BY)),
        "__number": F.row_number().over(_inside(order)),
        "__rank": F.rank().over(ties),
        "__dense": F.dense_rank().over(ties),
        "__upto": F.count(F.lit(1)).over(ties.rangeBetween(W.unboundedPreceding, W.currentRow)),
    }
    inner = ranged.withColumns(own)
    first, last = F.col("__number") == 1, F.col("__number") == F.col("__size")
    pick = lambda when, c: F.max(F.when(when, F.col(c)))
    edges = inner.where(first | last).groupBy(_RANGE, _BY).agg(
        F.max("__size").alias("n"), pick(last, "__dense").alias("d"), pick(first, "__value").alias("head"), pick(last, "__value").alias("tail"),
        pick(last, "__rank").alias("tail_rank"), pick(first, "__upto").alias("head_upto"),
    )
    along = W.partitionBy(_BY).orderBy(_RANGE)
    before, after = along.rowsBetween(W.unboundedPreceding, -1), along.rowsBetween(1, W.unboundedFollowing)
    zero = F.lit(0).cast("long")
    edges = edges.withColumns({
        "base": F.coalesce(F.sum("n").over(before), zero),
        "all": F.sum("n").over(W.partitionBy(_BY)),
        "goes_on": F.coalesce(F.lag(F.struct("tail")).over(along).eqNullSafe(F.struct(F.col("head").alias("tail"))), F.lit(False)),
        "continues": F.coalesce(F.lead(F.struct("head")).over(along).eqNullSafe(F.struct(F.col("tail").alias("head"))), F.lit(False)),
        "ranges": F.count(F.lit(1)).over(W.partitionBy(_BY)),
    })
    edges = edges.withColumns({
        "dense_base": F.coalesce(F.sum("d").over(before), zero) - F.sum(F.col("goes_on").cast("long")).over(along.rowsBetween(W.unboundedPreceding, W.currentRow)),
        "start": F.when(~F.col("goes_on") | (F.col("d") > 1), F.col("base") + F.col("tail_rank")),
        "end": F.when(~F.col("continues") | (F.col("d") > 1), F.col("base") + F.col("head_upto")),
    })
    edges = edges.withColumns({"began": F.last("start", ignorenulls=True).over(before), "ends": F.first("end", ignorenulls=True).over(after)}).where("ranges > 1")
    named = {c: f"__e_{c}" for c in ("head", "tail", "base", "all", "goes_on", "continues", "dense_base", "began", "ends")}
    met = _carry(inner, edges.select(_RANGE, _BY, *[F.col(c).alias(n) for c, n in named.items()]))
    e = lambda c: F.col(f"__e_{c}")
    base, size = F.coalesce(e("base"), zero), F.coalesce(e("all"), F.col("__size"))
    number = base + F.col("__number")
    rank = F.when(e("goes_on") & F.col("__value").eqNullSafe(e("head")), e("began")).otherwise(base + F.col("__rank"))
    upto = F.when(e("continues") & F.col("__value").eqNullSafe(e("tail")), e("ends")).otherwise(base + F.col("__upto"))

    def made(spec: str | tuple[str, int]) -> Column:
        match spec:
            case "row_number":
                return number
            case "rank":
                return rank
            case "dense_rank":
                return F.coalesce(e("dense_base"), zero) + F.col("__dense")
            case "percent_rank":
                return F.when(size > 1, (rank - 1) / (size - 1)).otherwise(F.lit(0.0))
            case "cume_dist":
                return upto / size
        n = F.lit(int(spec[1]))  # the first (size mod n) parts have a row more
        wide, more = F.floor(size / n) + 1, size % n
        return F.when(number <= wide * more, F.floor((number - 1) / wide)).otherwise(more + F.floor((number - 1 - wide * more) / (wide - 1))) + 1

    results = {k: made(v).cast("double" if kinds[k] in ("percent_rank", "cume_dist") else "long") for k, v in out.items()}
    return met.withColumns(results).select(*[c for c in df.columns if c not in out], *out)


"""Joins of intervals with intervals that overlap, as equality joins on cells of several widths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.ordered import ROWS, running
from tessella.sources.scratch import written

#: Rows of one side that meet in one cell, about; beyond it a cell is dealt out.
CELL_ROWS = 100_000
MOST_DEALS = 4096
#: Rows of both sides of a key that are compared each with each.
FEW = 1000

#: The least i with 2^i at least the length: binary digits of the length less one.
_LEVEL = "if(last = low, 0, length(bin(last - low)))"


def overlap_join(left: DataFrame, right: DataFrame, low: str, high: str, by: Sequence[str] = (), right_low: str | None = None, right_high: str | None = None, cell_rows: int = CELL_ROWS, few: int = FEW) -> DataFrame:
    """All pairs whose intervals [low, high) overlap and whose `by` are equal: the columns of `left`, then those of `right` other than `by`.

    Bounds are whole numbers, dates or timestamps, of one type on both sides; other column
    names differ. An interval that is empty or has a null bound, and a null in `by`, meet
    nothing.

    Rows whose `by` has at most `few` rows on both sides meet by it alone: they move once
    and none is copied. Those of other keys, and all without `by`, meet in cells.

    An interval of length up to 2^i has level i and lies in one or two cells of that width.
    Of a pair, the longer one stands in its own cells and the shorter one asks for those
    of the longer one's level, of which it also meets two at most. So nothing is copied in
    proportion to its length, and a range over all time stands in two cells: copies are
    bounded by the number of levels that the other side has. The first cell that both
    have gives the pair, once. Where many short intervals ask for one cell, they are dealt
    out by hash and the longer ones copied to each part.
    """
    right_low, right_high = right_low or low, right_high or high
    a, b = _bounded(left, low, high, by, "a"), _bounded(right, right_low, right_high, by, "b")
    keys = [f"__by{i}" for i in range(len(by))]
    pairs = None
    if by:
        sizes = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).unionByName(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
        many = written(sizes.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") > few).select(*keys), "keys-of-many")
        hot = not many.isEmpty()
        rest_a, rest_b = (x.join(many, keys, "left_anti") if hot else x for x in (a, b))
        pairs = rest_a.join(rest_b.withColumnsRenamed({"low": "low2", "last": "last2"}), keys).where("low <= last2 and low2 <= last")
        if hot:
            a, b = a.join(many, keys, "left_semi"), b.join(many, keys, "left_semi")
    outs = [*[F.col(f"__a{i}").alias(c) for i, c in enumerate(left.columns)], *[F.col(f"__b{i}").alias(c) for i, c in enumerate(right.columns) if c not in by]]
    if by and not hot:
        return pairs.select(*outs)
    a, b = (x.withColumn("level", F.expr(_LEVEL)) for x in (a, b))
    levels_a, levels_b = _levels(a), _levels(b)
    longer_left = _met(a, b, keys, levels_a, levels_b, cell_rows, equal=True)
    longer_right = _met(b, a, keys, levels_b, levels_a, cell_rows, equal=False)
    met = longer_left.select(*outs).unionByName(longer_right.select(*outs))
    return pairs.select(*outs).unionByName(met) if by else met


def overlap_counts(df: DataFrame, key: str, low: str, high: str, rows: int = ROWS) -> DataFrame:
    """(key, others): with how many intervals [low, high) of other keys those of a key overlap, pair by pair; keys without any are left out.

    No pair is made: an interval overlaps those that begin before its end, but for those
    that end by its begin, and both are running counts over all ends and begins in order,
    ends first. What a key's own intervals have in common is counted likewise and taken
    off. So work grows with the intervals, however many overlap. An empty interval, a null
    bound and a null key meet nothing.
    """
    kind = df.schema[low].dataType.simpleString()
    spans = df.select(F.col(key).alias("k"), _whole(F.col(low), kind).alias("low"), _whole(F.col(high), kind).alias("high")).where("k is not null and low < high")
    all_met = _counted(spans, [], rows).groupBy("k").agg(F.sum("n").alias("n"), F.sum("begins").alias("spans"))
    several = spans.groupBy("k").agg(F.count(F.lit(1)).alias("spans")).where("spans > 1").select("k")
    own = _counted(spans.join(several, "k", "left_semi"), ["k"], rows).groupBy("k").agg(F.sum("n").alias("own"))
    met = all_met.join(own, "k", "left").select(F.col("k").alias(key), (F.col("n") - F.coalesce("own", "spans")).alias("others"))
    return met.where("others > 0")


def _counted(spans: DataFrame, by: Sequence[str], rows: int) -> DataFrame:
    """(k, begins, n) for both bounds of each interval: the sum of n over them is how many overlap it, itself included."""
    bound = lambda c, begins: F.struct(F.col(c).alias("at"), F.lit(begins).cast("long").alias("begins"))
    bounds = spans.select("k", F.explode(F.array(bound("low", 1), bound("high", 0))).alias("b")).select("k", "b.*")
    seen = running(bounds, by, ["at", "begins"], sums={"__begun": F.col("begins"), "__ended": 1 - F.col("begins")}, rows=rows)
    return seen.select("k", "begins", F.when(F.col("begins") == 1, -F.col("__ended")).otherwise(F.col("__begun")).alias("n"))


def _whole(c: Column, kind: str) -> Column:
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp"))
    return F.unix_date(c).cast("long") if kind == "date" else c.cast("long")


def _bounded(df: DataFrame, low: str, high: str, by: Sequence[str], side: str) -> DataFrame:
    """(__by0.., the side's columns as __a0.. or __b0.., low, last): last is the greatest whole number in the interval. Columns that the caller drops aren't moved."""
    kind = df.schema[low].dataType.simpleString()
    keys, own = [F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], [F.col(c).alias(f"__{side}{i}") for i, c in enumerate(df.columns)]
    rows = df.select(*keys, *own, _whole(F.col(low), kind).alias("low"), (_whole(F.col(high), kind) - 1).alias("last"))
    return rows.dropna(subset=[f"__by{i}" for i in range(len(by))]).where("low <= last") if by else rows.where("low <= last")


def _levels(rows: DataFrame) -> dict[int, tuple[int, int, int]]:
    """Rows, least low and greatest last of each level: at most 64 rows."""
    found = rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.max("last").alias("last"))
    return {r.level: (r.n, r.low, r.last) for r in found.collect()}


def _met(longer: DataFrame, shorter: DataFrame, keys: Sequence[str], own: dict, other: dict, cell_rows: int, equal: bool) -> DataFrame:
    """Pairs whose first side has the higher level, or the same if `equal`."""
    sides, asks = ([c for c in x.columns if c[:3] in ("__a", "__b") and c not in keys] for x in (longer, shorter))
    usable = {i: _deals(i, {j: x for j, x in other.items() if j <= i}, cell_rows) for i in own if any(j < i or equal and j == i for j in other)}
    deals = F.create_map(*[F.lit(x) for i, n in usable.items() for x in (i, n)]) if usable else F.create_map().cast("map<int,int>")
    cells = F.expr("array_distinct(array(shiftright(low, level), shiftright(last, level)))")
    held = longer.where(F.col("level").isin(list(usable))).withColumn("deals", F.element_at(deals, F.col("level")))
    held = held.select(*keys, *sides, "low", "last", "level", F.explode(cells).alias("cell"), "deals")
    held = held.select(*keys, *sides, "low", "last", "level", "cell", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    above = F.filter(F.array(*[F.lit(i) for i in sorted(usable)]).cast("array<int>"), lambda i: (i >= F.col("level")) if equal else (i > F.col("level")))
    asking = shorter.select(*keys, *asks, F.col("low").alias("low2"), F.col("last").alias("last2"), F.explode(above).alias("level"), F.col("low"), F.col("last"))
    asking = asking.select(*keys, *asks, "low2", "last2", "level", F.explode(cells).alias("cell"))
    dealt = F.pmod(F.xxhash64("low2", "last2", *asks), F.element_at(deals, F.col("level"))) if any(n > 1 for n in usable.values()) else F.lit(0)
    asking = asking.withColumn("deal", dealt.cast("int"))
    first = F.expr("greatest(shiftright(low, level), shiftright(low2, level))")
    met = held.join(asking, [*keys, "level", "cell", "deal"])
    return met.where((F.col("low") <= F.col("last2")) & (F.col("low2") <= F.col("last")) & (F.col("cell") == first))


def _deals(level: int, askers: dict, cell_rows: int) -> int:
    """Parts of a cell of this level: the shorter rows over the cells that they reach, by `cell_rows`."""
    n = sum(x[0] for x in askers.values())
    span = max(x[2] for x in askers.values()) - min(x[1] for x in askers.values()) + 1
    cells = max(1, span >> level)
    return max(1, min(MOST_DEALS, -(-n // (cells * cell_rows))))

"""Time series per key without gaps: a row for every step, with values carried on or interpolated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.ordered import ROWS, running

#: Steps that a row is unfolded to at a time.
CHUNK = 4096


def gap_filled(df: DataFrame, by: Sequence[str], time: str, step: int, measures: Mapping[str, Column], carried: Sequence[str] = (), linear: Sequence[str] = (), rows: int = ROWS) -> DataFrame:
    """(by, time, measures, m_carried, m_linear): each key's steps of `step` seconds from its first to its last, with the measures of the rows in each.

    A step without rows has null measures. `m_carried` is the last value of m that isn't
    null at or before the step; `m_linear` lies on the line between that and the next one,
    null before the first and after the last. Steps start at whole multiples of `step`
    since 1970.

    Values are carried among the steps that have rows, within ranges of (key, time) and
    over their borders, so a key of any length is no window. Each of these steps knows the
    next one and is unfolded up to it where it stands, in chunks, as a long pause with
    short steps fits no array: what fills the gaps is neither moved nor sorted. Null keys
    are a key; rows with a null time are left out.
    """
    micros = step * 1_000_000
    kind = df.schema[time].dataType
    moment = F.unix_micros(F.col(time).cast("timestamp"))
    number = (moment - F.pmod(moment, F.lit(micros))) / micros
    key = F.struct(*by).alias("__key") if by else F.struct(F.lit(0).alias("all")).alias("__key")
    held = df.where(F.col(time).isNotNull()).withColumns({"__step": number.cast("long"), "__key": key}).groupBy("__key", "__step").agg(*[c.alias(k) for k, c in measures.items()])
    known = lambda m: F.when(F.col(m).isNotNull(), F.struct(F.col("__step").alias("at"), F.col(m).alias("is")))
    lasts, nexts = {f"__last_{m}": known(m) for m in dict.fromkeys([*carried, *linear])}, {f"__next_{m}": known(m) for m in linear}
    met = running(held, ["__key"], ["__step"], lasts=lasts, nexts=nexts | {"__until": F.col("__step")}, rows=rows, unique=True)
    until = F.coalesce(F.col("__until") - 1, "__step")
    chunks = met.withColumn("__from", F.explode(F.sequence("__step", until, F.lit(CHUNK).cast("long"))))
    own = F.col("__step") == F.col("__first")
    full = chunks.withColumns({"__first": F.col("__step"), "__step": F.explode(F.sequence("__from", F.least(until, F.col("__from") + CHUNK - 1)))})
    full = full.withColumns({f"__next_{m}": F.when(own & F.col(m).isNotNull(), F.col(f"__last_{m}")).otherwise(F.col(f"__next_{m}")) for m in linear})
    full = full.withColumns({m: F.when(own, F.col(m)) for m in measures})

    def between(m: str) -> Column:
        a, b = F.col(f"__last_{m}"), F.col(f"__next_{m}")
        part = (F.col("__step") - a["at"]) / (b["at"] - a["at"])
        return F.when(a["at"] == b["at"], a["is"].cast("double")).otherwise(a["is"] + (b["is"] - a["is"]) * part)

    start = F.timestamp_micros(F.col("__step") * micros).cast(kind)
    out = [F.col(f"__last_{m}")["is"].alias(f"{m}_carried") for m in carried] + [between(m).alias(f"{m}_linear") for m in linear]
    return full.select(*[F.col(f"__key.{c}").alias(c) for c in by], start.alias(time), *measures, *out)

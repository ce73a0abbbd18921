"""Aggregates of one's own in two phases: partial states in every task, by Arrow batches, which are merged after a shuffle of states."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tessella.operators.ordered import LEAST, ROWS
from tessella.shipping import ship
from tessella.sources.scratch import written

#: Keys whose states a task holds before it passes them on.
HELD_KEYS = 50_000


class Aggregate(Protocol):
    """States are picklable, and of a size that doesn't grow with the rows they stand for. Merging is associative and commutative."""

    def create(self) -> Any: ...

    def update(self, state: Any, columns: Sequence[np.ndarray]) -> Any:
        """The state after further rows, of which none has a null."""

    def merge(self, a: Any, b: Any) -> Any: ...

    def result(self, state: Any) -> Any: ...


def two_phase(df: DataFrame, by: Sequence[str], columns: Sequence[str], aggregate: Aggregate, out: str, kind: str, rounds_of: int = 256) -> DataFrame:
    """(by, out): the aggregate over the rows of each key, `kind` being its type.

    A task keeps a state for each key that it meets and updates it batch by batch; only
    states are shuffled, so a key of nine tenths of the rows is a state a task. States
    merge in two rounds, first in `rounds_of` parts of each key, so that no task gets the
    states of all tasks. Rows with a null in `columns` count for nothing; keys without
    other rows keep the result of an empty state. Null keys are a key. Columns are numbers.
    """
    ship(df.sparkSession)
    keys = df.select(*by).schema
    names = [f"k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    schema = StructType([*rows.select(*names).schema.fields, *StructType.fromDDL("state binary, part int").fields])
    n_keys = len(names)
    done = StructType([*rows.select(*names).schema.fields, *StructType.fromDDL(f"`{out}` {kind}").fields])
    result_type = to_arrow_type(done[out].dataType)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Any] = {}
        for batch in batches:
            for key, values in _grouped(batch, n_keys):
                held[key] = aggregate.update(held[key] if key in held else aggregate.create(), values)
            if len(held) > HELD_KEYS:
                yield _packed(held, names, batch.schema, rounds_of)
                held = {}
        if held:
            yield _packed(held, names, batch.schema, rounds_of)

    def merged(table: pa.Table) -> Any:
        state = aggregate.create()
        for x in table.column("state").to_pylist():
            state = aggregate.merge(state, pickle.loads(x))  # noqa: S301  what this operator's tasks wrote
        return state

    def once(table: pa.Table) -> pa.Table:
        return table.slice(0, 1).set_column(n_keys, "state", pa.array([pickle.dumps(merged(table))], pa.binary()))

    def last(table: pa.Table) -> pa.Table:
        return table.slice(0, 1).select(names).append_column(out, pa.array([aggregate.result(merged(table))], result_type))

    states = rows.mapInArrow(partial, schema)
    states = states.groupBy(*names, "part").applyInArrow(once, schema)
    return states.groupBy(*names).applyInArrow(last, done).toDF(*keys.names, out)


def _grouped(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Each key of the batch with the values of its rows."""
    values = [c.to_numpy(zero_copy_only=False) for c in batch.columns[n_keys:]]
    full = np.ones(len(batch), bool)
    for c in batch.columns[n_keys:]:
        full &= c.is_valid().to_numpy(zero_copy_only=False)
    keys = [pc.dictionary_encode(c, null_encoding="encode") for c in batch.columns[:n_keys]]
    code = np.zeros(len(batch), np.int64)
    for k in keys:
        code = np.unique(code * max(1, len(k.dictionary)) + k.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    for rows in np.split(order, starts[1:]) if len(order) else []:
        at = int(rows[0])
        kept = rows[full[rows]]
        yield tuple(c[at].as_py() for c in batch.columns[:n_keys]), [v[kept] for v in values]


def _packed(held: dict[tuple, Any], names: list[str], schema: pa.Schema, rounds_of: int) -> pa.RecordBatch:
    """The states as rows; the part is told by the task's partition, so that a rerun gives the same rows."""
    context = TaskContext.get()
    part = (context.partitionId() if context else 0) % rounds_of
    columns = [pa.array([k[i] for k in held], schema.field(i).type) for i in range(len(names))]
    states = pa.array([pickle.dumps(s) for s in held.values()], pa.binary())
    return pa.RecordBatch.from_arrays([*columns, states, pa.array([part] * len(held), pa.int32())], [*names, "state", "part"])


def in_order(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], aggregate: Aggregate, out: str, kind: str, rows: int = ROWS) -> DataFrame:
    """(by, out): an aggregate whose result depends on the order of a key's rows; `merge(a, b)` only has to be associative, a standing before b.

    The table is sorted once in ranges of (by, order, columns) of about `rows` rows, which a
    task reads batch by batch, with the state of one key at a time. A key inside a range is
    done there. Only the first and the last key of a range can go on in others: their
    states, two a range, are merged in the order of the ranges. So a key may be the whole
    table, and most keys are never grouped. Rows that tie in all columns are alike and stand
    in one range. Nulls in `columns` come as nan; null keys are a key. Columns are numbers.
    """
    ship(df.sparkSession)
    keys = df.select(*by).schema
    names, n_keys = [f"k{i}" for i in range(len(by))], len(by)
    falls = [c.endswith(" desc") for c in order]
    sort = [f"o{i}" for i in range(len(order))]
    given = [F.col(c.removesuffix(" desc")).alias(n) for c, n in zip(order, sort, strict=True)]
    values = [F.coalesce(F.col(c).cast("double"), F.lit(math.nan)).alias(f"v{i}") for i, c in enumerate(columns)]
    placed = df.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], *given, *values)
    along = [*names, *[F.desc(n) if x else F.asc(n) for n, x in zip(sort, falls, strict=True)], *[f"v{i}" for i in range(len(columns))]]
    parts = max(LEAST, -(-df.count() // rows))
    ranged = placed.repartitionByRange(parts, *along).sortWithinPartitions(*along).drop(*sort)
    own = StructType(placed.select(*names).schema.fields)
    done = StructType([*own.fields, *StructType.fromDDL(f"result {kind}").fields])
    schema = StructType([*done.fields, *StructType.fromDDL("state binary, at int").fields])
    result_type = to_arrow_type(done["result"].dataType)
    types = [*[to_arrow_type(f.dataType) for f in own.fields], result_type, pa.binary(), pa.int32()]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, key, state, first = TaskContext.get().partitionId(), None, None, True
        for batch in batches:
            made = []
            for now, own_values in _runs(batch, n_keys):
                if now != key:
                    if key is not None:
                        made.append((*key, None, pickle.dumps(state), at) if first else (*key, aggregate.result(state), None, at))
                        first = False
                    key, state = now, aggregate.create()
                state = aggregate.update(state, own_values)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], schema.names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*key, None, pickle.dumps(state), at), types, strict=True)], schema.names)

    def last(table: pa.Table) -> pa.Table:
        state = aggregate.create()
        for x in table.sort_by("at").column("state").to_pylist():
            state = aggregate.merge(state, pickle.loads(x))  # noqa: S301  what this operator's tasks wrote
        return pa.Table.from_arrays([*[table.column(n).slice(0, 1) for n in names], pa.array([aggregate.result(state)], result_type)], done.names)

    found = written(ranged.mapInArrow(partial, schema), "in-order")
    edges = found.where("state is not null").select(*names, "state", "at").groupBy(*names).applyInArrow(last, done)
    return found.where("state is null").select(*done.names).unionByName(edges).toDF(*keys.names, out)


def _runs(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """The keys of a sorted batch, each with the values of its rows."""
    values = [c.to_numpy(zero_copy_only=False) for c in batch.columns[n_keys:]]
    new = np.zeros(len(batch), bool)
    new[:1] = True
    for c in batch.columns[:n_keys]:
        codes = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(new)
    heads = [c.take(pa.array(starts)).to_pylist() for c in batch.columns[:n_keys]]
    for i, (low, high) in enumerate(zip(starts, [*starts[1:], len(batch)], strict=True)):
        yield tuple(h[i] for h in heads), [v[low:high] for v in values]


# Aggregates that Spark lacks.


class ExactSum:
    """The sum of doubles, rounded once: the same whatever the order of rows and however they are dealt to tasks.

    A state is a list of doubles that don't overlap, whose sum is exact: at most about 40.
    """

    def create(self) -> list[float]:
        return []

    def update(self, state: list[float], columns: Sequence[np.ndarray]) -> list[float]:
        return _partials([*state, *columns[0].tolist()])

    def merge(self, a: list[float], b: list[float]) -> list[float]:
        return _partials([*a, *b])

    def result(self, state: list[float]) -> float | None:
        return math.fsum(state) if state else None


def _partials(values: list[float]) -> list[float]:
    """Doubles with the same exact sum, of rising size, that don't overlap. Infinities and nan take the place of all."""
    out: list[float] = []
    for x in values:
        if not math.isfinite(x):
            return [sum(v for v in values if not math.isfinite(v))]
        kept = 0
        for y in out:
            if abs(x) < abs(y):
                x, y = y, x
            high = x + y
            if low := y - (high - x):
                out[kept] = low
                kept += 1
            x = high
        out[kept:] = [x]
    return out


class Regression:
    """Least squares with an intercept: coefficients of the columns before the last, the intercept first, for the last one.

    A state holds sums of products around a shift that the first row gives, so that large
    means take no digits away. Null where the columns are collinear or rows too few.
    """

    def create(self) -> tuple | None:
        return None

    def update(self, state: tuple | None, columns: Sequence[np.ndarray]) -> tuple | None:
        if not len(columns[0]):
            return state
        x = np.stack(columns, axis=1)
        shift = x.mean(axis=0)
        centred = x - shift
        return self.merge(state, (len(x), shift, centred.T @ centred))

    def merge(self, a: tuple | None, b: tuple | None) -> tuple | None:
        if a is None or b is None:
            return a or b
        (n, mean_a, s_a), (m, mean_b, s_b) = a, b
        apart = mean_b - mean_a
        return n + m, mean_a + apart * (m / (n + m)), s_a + s_b + np.outer(apart, apart) * (n * m / (n + m))

    def result(self, state: tuple | None) -> list[float] | None:
        if state is None:
            return None
        n, mean, s = state
        k = len(mean) - 1
        spread = np.sqrt(np.diag(s)[:k])
        if n <= k or (spread == 0).any() or np.linalg.cond(s[:k, :k] / np.outer(spread, spread)) > 1e12:
            return None
        slopes = np.linalg.solve(s[:k, :k], s[:k, k])
        return [float(mean[k] - slopes @ mean[:k]), *map(float, slopes)]


class LongestRise:
    """The most rows in a row of which each is greater than the one before; nan is greater than nothing, and nothing than it.

    A state tells of its stretch of rows: how many, the first and the last value, how many
    rise from its start, how many to its end, and how many at most.
    """

    def create(self) -> tuple | None:
        return None

    def update(self, state: tuple | None, columns: Sequence[np.ndarray]) -> tuple | None:
        x = columns[0]
        if not len(x):
            return state
        breaks = np.flatnonzero(~(x[1:] > x[:-1])) + 1
        runs = np.diff(breaks, prepend=0, append=len(x))
        return self.merge(state, (len(x), float(x[0]), float(x[-1]), int(runs[0]), int(runs[-1]), int(runs.max())))

    def merge(self, a: tuple | None, b: tuple | None) -> tuple | None:
        if a is None or b is None:
            return a or b
        (n, first, end, head, tail, best), (m, start, last, head_b, tail_b, best_b) = a, b
        rises = start > end
        return (
            n + m, first, last,
            n + head_b if rises and head == n else head,
            m + tail if rises and tail_b == m else tail_b,
            max(best, best_b, tail + head_b if rises else 0),
        )

    def result(self, state: tuple | None) -> int | None:
        return state and state[5]


def longest_rise(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str = "longest", rows: int = ROWS) -> DataFrame:
    return in_order(df, by, order, [value], LongestRise(), out, "long", rows)


def regression(df: DataFrame, by: Sequence[str], x: Sequence[str], y: str, out: str = "coefficients") -> DataFrame:
    return two_phase(df, by, [*x, y], Regression(), out, "array<double>")


def exact_sum(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    return two_phase(df, by, [value], ExactSum(), out, "double")

"""A Python data source over the row groups of Parquet files: partitions are left out by pushed filters, in batches and in streams.

    segment_rows(spark, path, "k >= 50")
    spark.dataSource.register(SegmentSource)
    spark.readStream.format("segments").option("segmentsPerBatch", 4).load(path)

A segment is a row group. Its column statistics, which stand in the file's footer, tell
whether any of its rows can pass the filters that Spark pushes down; if not, no task is
made for it. Spark still applies the filters to the rows. Each row has the number of its
segment in the column `segment`, counted over all segments, so a result shows which ones
were read. Filters are pushed where spark.sql.python.filterPushdown.enabled is true.

Spark 4.1 keeps what has been pushed to a table of a Python source with that table: a
second query on the same loaded DataFrame, with other filters or none, would miss rows
of segments that the first left out. `segment_rows` loads a table for each condition;
whoever loads by format does likewise, or leaves that setting off.

Paths are those that pyarrow's file systems open: local ones, and those of stores that it
knows. Files are taken in order of their names; names that start with "_" or "." are
left out. Nested columns have no statistics and never leave a segment out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from tessella.shipping import ship


@dataclass
class Segment(InputPartition):
    file: str
    group: int
    number: int

    def __init__(self, file: str, group: int, number: int) -> None:
        super().__init__(number)
        self.file, self.group, self.number = file, group, number


def _opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    system, inside = _opened(path)
    if system.get_file_info(inside).type == pa.fs.FileType.File:
        return [path]
    found = system.get_file_info(pa.fs.FileSelector(inside, recursive=True))
    prefix = path.removesuffix(inside) if path.endswith(inside) else ""
    named = [x.path for x in found if x.type == pa.fs.FileType.File and not any(p.startswith(("_", ".")) for p in x.path[len(inside) :].split("/"))]
    return [prefix + x for x in sorted(named)]


def _footer(file: str) -> pq.FileMetaData:
    system, inside = _opened(file)
    with system.open_input_file(inside) as f:
        return pq.ParquetFile(f).metadata


def _segments(path: str) -> Iterator[tuple[Segment, pq.RowGroupMetaData]]:
    number = 0
    for file in _files(path):
        footer = _footer(file)
        for group in range(footer.num_row_groups):
            yield Segment(file, group, number), footer.row_group(group)
            number += 1


def _bounds(group: pq.RowGroupMetaData, column: str) -> tuple[Any, Any, int | None] | None:
    """(least, greatest, nulls) of a column; None where the footer doesn't say."""
    for i in range(group.num_columns):
        chunk = group.column(i)
        if chunk.path_in_schema == column:
            s = chunk.statistics
            if s is None or not s.has_min_max:
                return (None, None, s.null_count) if s is not None and s.has_null_count else None
            return s.min, s.max, s.null_count if s.has_null_count else None
    return None


def _comparable(bound: Any, value: Any) -> bool:
    """Text and numbers, times and times: where the types differ nothing is concluded."""
    return type(bound) is type(value) or all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (bound, value))


def may_pass(group: pq.RowGroupMetaData, f: Filter) -> bool:
    """Whether a row of the group can pass the filter, as far as its statistics tell."""
    bounds = _bounds(group, ".".join(f.attribute)) if len(f.attribute) == 1 else None
    if bounds is None:
        return True
    least, greatest, nulls = bounds
    match f:
        case IsNull():
            return nulls != 0
        case IsNotNull():
            return nulls is None or nulls < group.num_rows
    if least is None or nulls == group.num_rows:  # only nulls, or no statistics
        return nulls != group.num_rows
    within = lambda v: not (_comparable(least, v) and _comparable(greatest, v)) or least <= v <= greatest
    if isinstance(f, In):
        return any(v is not None and within(v) for v in f.value)
    if isinstance(f, EqualTo):
        return within(f.value)
    if not (_comparable(least, f.value) and _comparable(greatest, f.value)):
        return True
    match f:
        case GreaterThan():
            return greatest > f.value
        case GreaterThanOrEqual():
            return greatest >= f.value
        case LessThan():
            return least < f.value
        case LessThanOrEqual():
            return least <= f.value
    return True


_PUSHED = (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In, IsNull, IsNotNull)


class _Rows:
    """Reads segments, in tasks."""

    def __init__(self, schema: StructType) -> None:
        self.names = [f.name for f in schema if f.name != "segment"]
        self.order = schema.names

    def read(self, partition: Segment | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # as Spark has it where there are no segments to read
            return
        system, inside = _opened(partition.file)
        with system.open_input_file(inside) as f:
            file = pq.ParquetFile(f)
            for batch in file.iter_batches(batch_size=10_000, row_groups=[partition.group], columns=self.names):
                number = pa.repeat(pa.scalar(partition.number, pa.int64()), len(batch))
                columns = {"segment": number} | dict(zip(batch.schema.names, batch.columns, strict=True))
                yield pa.RecordBatch.from_arrays([columns[c] for c in self.order], self.order)


class SegmentReader(_Rows, DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        super().__init__(schema)
        self.path, self.filters = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Keeps what statistics can be held against; Spark applies all of them again, as a segment that is read has other rows too."""
        self.filters = [f for f in filters if isinstance(f, _PUSHED)]
        return filters

    def partitions(self) -> list[Segment]:
        return [s for s, group in _segments(self.path) if all(may_pass(group, f) for f in self.filters)]


class SegmentStreamReader(_Rows, DataSourceStreamReader):
    """Offsets count segments. Files are only added, with names after those that are there."""

    def __init__(self, path: str, schema: StructType, per_batch: int) -> None:
        super().__init__(schema)
        self.path, self.per_batch, self.at = path, per_batch, 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"segments": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        there = sum(_footer(f).num_row_groups for f in _files(self.path))
        self.at = min(there, self.at + self.per_batch)
        return {"segments": self.at}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        self.at = max(self.at, end["segments"])  # after a restart the stream goes on where it was
        return [s for s, _ in _segments(self.path) if start["segments"] <= s.number < end["segments"]]

    def commit(self, end: dict) -> None:
        pass


class SegmentSource(DataSource):
    """Options: path, and for streams segmentsPerBatch (all that is there, by default)."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def _path(self) -> str:
        if not (path := self.options.get("path")):
            raise ValueError("segments are read from a path")
        return path

    def schema(self) -> StructType:
        files = _files(self._path())
        if not files:
            raise ValueError(f"no files in {self._path()}")
        system, inside = _opened(files[0])
        with system.open_input_file(inside) as f:
            own = from_arrow_schema(pq.ParquetFile(f).schema_arrow, prefer_timestamp_ntz=True)
        return StructType([*[x for x in own if x.name != "segment"], StructField("segment", LongType())])

    def reader(self, schema: StructType) -> SegmentReader:
        return SegmentReader(self._path(), schema)

    def streamReader(self, schema: StructType) -> SegmentStreamReader:  # noqa: N802
        return SegmentStreamReader(self._path(), schema, int(self.options.get("segmentsPerBatch", 1 << 30)))


def segment_rows(spark: SparkSession, path: str, condition: str = "true") -> DataFrame:
    """The rows that meet the condition, from a table of their own."""
    ship(spark)
    spark.dataSource.register(SegmentSource)
    return spark.read.format("segments").load(path).where(condition)

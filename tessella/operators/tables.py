"""Table functions over a TABLE argument, whose output columns follow from the input's.

    spark.udtf.register("changes", CHANGES)
    SELECT * FROM changes(TABLE(SELECT ...) PARTITION BY (k) ORDER BY (t), 'a', 'b')
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, Row, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class Changes:
    """Runs of rows, in the order of the call, within which the named columns stay the same: the first row of each, all its columns, and `run_rows`, how many the run has.

    Without names, all columns count. Only the first row of the current run is held, so a
    partition of any size passes in one go. Nulls are values like others. A column of the
    input must not be named run_rows.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, *columns: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table")
        names = [c.value for c in columns]
        if any(n not in rows.dataType.names for n in names):
            raise ValueError(f"the table has no column of these: {', '.join(sorted(set(map(str, names)) - set(rows.dataType.names)))}")
        if "run_rows" in rows.dataType.names:
            raise ValueError("the table has a column run_rows of its own")
        return AnalyzeResult(StructType([*rows.dataType.fields]).add("run_rows", LongType()))

    def __init__(self) -> None:
        self.first, self.value, self.n = None, None, 0

    def eval(self, row: Row, *columns: str) -> Iterator[tuple]:
        value = tuple(row[c] for c in columns) if columns else tuple(row)
        if self.n and value == self.value:
            self.n += 1
            return
        if self.n:
            yield (*self.first, self.n)
        self.first, self.value, self.n = tuple(row), value, 1

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            yield (*self.first, self.n)


CHANGES = udtf(Changes)

"""Words of Arrow batches as numbers, a bounded part of a batch at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, text: int, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `size` bytes of text, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(lengths, dtype=np.int64), 0
    while start < len(batch):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def parts(batch: pa.RecordBatch, text: int, size: int = PART_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Those slices with their texts: nulls empty, A-Z lower-cased."""
    for part in slices(batch, text, size):
        yield part, pc.ascii_lower(pc.fill_null(part.column(text), "")).to_pylist()


class Numbers(dict):
    """A number for each word, in the order that they come in."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def of(self, texts: list[str], pattern: re.Pattern) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words of all texts, how many each text has)."""
        each = [np.fromiter(map(self.__getitem__, pattern.findall(t)), np.int64) for t in texts]
        return np.concatenate(each) if each else np.zeros(0, np.int64), np.array([len(x) for x in each], np.int64)

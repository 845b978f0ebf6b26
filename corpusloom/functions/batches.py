"""Arrow batches in slices, so that what a task holds as Python objects is bounded by bytes and not by rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the measured columns in a slice. A row that is larger is a slice of its own.
SLICE = 1 << 20


def _sizes(column: pa.Array) -> np.ndarray:
    """The bytes of each value of a string, binary or list column, about."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        each = 16 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        if pa.types.is_string(column.type.value_type):
            inner = np.append(0, np.cumsum(_sizes(column.flatten())))
            n = each // 16
            ends = np.cumsum(n)
            each = each + inner[ends] - inner[ends - n]
        return each.astype(np.int64)
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def bounds(columns: list[pa.Array], size: int = SLICE) -> Iterator[tuple[int, int]]:
    """(first row, rows) of the slices in which the columns have up to `size` bytes; a row counts 64 at least."""
    n = len(columns[0])
    ends = np.cumsum(sum(map(_sizes, columns), np.full(n, 64)))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield at, to - at
        at = to


def slices(batch: pa.RecordBatch, *columns: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices by the bytes of these columns."""
    for at, n in bounds([batch.column(c) for c in columns], size):
        yield batch.slice(at, n)

"""Whole groups out of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def group_starts(table: pa.Table | pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Places where a new value of the (integer, non-null) key columns starts."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows again as tables that hold whole groups: many small ones together, or a single large one. Rows must be
    sorted so that equal keys follow each other; memory is bounded by a batch and the largest group."""
    held: list[pa.RecordBatch] = []  # the open group
    for b in batches:
        if not b.num_rows:
            continue
        if held and any(held[-1].column(k)[0].as_py() != b.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        last = int(group_starts(b, keys)[-1])
        if last:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def pieces(batch: pa.RecordBatch, size: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """The batch cut where the sizes of its rows add up to about ``most``; a row over it stands alone."""
    total, lo = np.cumsum(size, dtype=np.int64), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi

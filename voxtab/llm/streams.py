"""Streams of Arrow batches: short slices, and groups of consecutive rows."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def give_back() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows; an empty one stays.

    At the end of a partition, freed memory goes back to the system: a worker
    outlives its task, beside those of other stages.
    """
    for b in batches:
        for lo in range(0, max(1, b.num_rows), rows):
            yield b.slice(lo, rows)
    give_back()


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of rows that agree in their first `keys` (integer) columns, from batches sorted by them.

    Only the rows of one batch and of the group that crosses its end are held.
    """
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        if held:
            change[0] = any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != cols[k][0] for k in range(keys))
        lo = 0
        for cut in np.flatnonzero(change):
            if cut > lo:
                held.append(b.slice(lo, cut - lo))
            if held:
                yield pa.Table.from_batches(held)
            held, lo = [], int(cut)
        held.append(b.slice(lo))
    if held:
        yield pa.Table.from_batches(held)

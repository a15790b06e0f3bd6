"""Connected pieces of voxels inside blocks of space, block by block inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from voxtab.operators.ways import codes, paired

#: The width of a block in steps, and the rows that are labelled at a time (a block's rows stay together).
EDGE, ROWS = 64, 200_000


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number of the component of each of n nodes, by edges a - b."""
    least = np.arange(n)
    while len(a):
        x, y = least[a], least[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := least[least], least):
            least = up
    return least


def label(rows: pa.Table, on: list[str], offsets: list[tuple[int, int, int]]) -> np.ndarray:
    """The row that holds the least key of each row's piece, of neighbours at the offsets in the same `on` columns and block; rows without a place (_ok is false) stand alone."""
    ok = rows.column("_ok").to_numpy(zero_copy_only=False).astype(bool)
    at = np.flatnonzero(ok)
    out = np.arange(len(ok))
    if not len(at):
        return out
    x = rows.take(pa.array(at)) if len(at) < len(ok) else rows
    group = codes(x.column("_block"))[0]
    for c in on:
        group = paired([group], codes(x.column(c)))[0]
    place, wide = np.zeros(len(at), np.int64), EDGE + 2  # a margin all around, where no voxel is
    for a in "ijk":
        place = place * wide + x.column(a).to_numpy().astype(np.int64) % EDGE + 1
    nodes, first, of = np.unique(group * wide**3 + place, return_index=True, return_inverse=True)
    a, b = [], []
    for i, j, k in offsets:
        to = nodes + (i * wide + j) * wide + k
        met = np.minimum(np.searchsorted(nodes, to), len(nodes) - 1)
        hit = np.flatnonzero(nodes[met] == to)
        a.append(hit)
        b.append(met[hit])
    out[at] = at[first[roots(np.concatenate(a), np.concatenate(b), len(nodes))][of.reshape(-1)]]
    return out


def in_groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """The rows, which come ordered by these columns, some at a time, rows that agree in them together."""
    held, n, most = [], 0, ROWS
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            rows = pa.Table.from_batches(held)
            last = np.ones(n, bool)
            for c in columns:
                code = codes(rows.column(c))[0]
                last &= code == code[-1]
            whole = n - (n if last.all() else int(np.argmin(last[::-1])))
            if whole:
                yield rows.slice(0, whole)
            held, n = rows.slice(whole).to_batches(), n - whole
            most = max(ROWS, 2 * n)
    if n:
        yield pa.Table.from_batches(held)


def labelled(batches: Iterator[pa.RecordBatch], on: list[str], offsets: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """The rows, which come block by block, with _root: the least _key of their piece inside the block."""
    for rows in in_groups(batches, ["_block", *on]):
        root = rows.column("_key").take(pa.array(label(rows, on, offsets)))
        yield from rows.append_column("_root", root).combine_chunks().to_batches(max_chunksize=50_000)

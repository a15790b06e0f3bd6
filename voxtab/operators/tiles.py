"""Closing inside tiles of space, as the bits of a word per (i, j), tile by tile inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from voxtab.operators.pieces import in_groups
from voxtab.operators.ways import codes, paired

#: Tiles that are held as words at a time.
HELD = 512
TILE = ("case_id", "ti", "tj", "tk")


def _shift(words: np.ndarray, n: int) -> np.ndarray:
    return words << np.uint64(n) if n >= 0 else words >> np.uint64(-n)


def _closed(own: np.ndarray, shut: np.ndarray, ball: list[tuple[int, int, int]], margin: tuple[int, int, int], wide: tuple[int, int, int]) -> np.ndarray:
    """own (tile, i, j) dilated and eroded, without what is shut, and own, inside the margins."""
    n, m = own.shape[1:]
    along: dict[tuple[int, int], list[int]] = {}
    for i, j, k in ball:
        along.setdefault((i, j), []).append(k)
    grown = np.zeros_like(own)
    for (i, j), ks in along.items():
        to, at = (np.s_[:, max(i, 0) : n + min(i, 0), max(j, 0) : m + min(j, 0)] for i, j in ((i, j), (-i, -j)))
        grown[to] |= np.bitwise_or.reduce([_shift(own[at], k) for k in ks])
    a, b = margin[0], margin[1]
    kept = np.full((len(own), wide[0], wide[1]), np.uint64(2**64 - 1))
    for (i, j), ks in along.items():
        part = grown[:, a + i : a + i + wide[0], b + j : b + j + wide[1]]
        kept &= np.bitwise_and.reduce([_shift(part, -k) for k in ks])
    inside = np.s_[:, a : a + wide[0], b : b + wide[1]]
    return ((kept & ~shut[inside]) | own[inside]) & np.uint64(((1 << wide[2]) - 1) << margin[2])


def closed(batches: Iterator[pa.RecordBatch], ball: list[tuple[int, int, int]], margin: tuple[int, int, int], wide: tuple[int, int, int], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(case_id, i, j, k) of the closing of rows (case_id, ti, tj, tk, i, j, k, shut) that come tile by tile; those that are shut only keep others out."""
    for rows in in_groups(batches, list(TILE)):
        of = codes(rows.column("case_id"))[0]
        at = {c: rows.column(c).to_numpy().astype(np.int64) for c in ("ti", "tj", "tk", "i", "j", "k")}
        for c in TILE[1:]:
            of = paired([of], codes(rows.column(c)))[0]
        first, of = np.unique(of, return_index=True, return_inverse=True)[1:]
        order = np.argsort(of := of.reshape(-1), kind="stable")
        shut = rows.column("shut").to_numpy(zero_copy_only=False).astype(bool)
        x, y, bit = (at[a] - at["t" + a] * w + m for a, m, w in zip("ijk", margin, wide))
        word = np.uint64(1) << bit.astype(np.uint64)
        for lo in range(0, len(first), HELD):
            mine = order[slice(*np.searchsorted(of[order], [lo, lo + HELD]))]
            held = [np.zeros((min(HELD, len(first) - lo), wide[0] + 2 * margin[0], wide[1] + 2 * margin[1]), np.uint64) for _ in range(2)]
            for which, words in enumerate(held):
                some = mine[shut[mine] == which]
                np.bitwise_or.at(words, (of[some] - lo, x[some], y[some]), word[some])
            found = _closed(*held, ball, margin, wide)
            t, i, j = np.nonzero(found)
            n, k = np.nonzero(np.unpackbits(found[t, i, j].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            tile = first[lo + t[n]]
            place = [at["t" + a][tile] * w + p for a, w, p in zip("ijk", wide, (i[n], j[n], k - margin[2]))]
            out = pa.table([rows.column("case_id").take(pa.array(tile)), *map(pa.array, place)], names=["case_id", "i", "j", "k"])
            yield from out.cast(schema).combine_chunks().to_batches(max_chunksize=50_000)

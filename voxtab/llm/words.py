"""Vectorised word arrays over Arrow string columns.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, so every other
Unicode character belongs to a word. Hashes are 64-bit and computed for all words
of a block at once from prefix sums of a polynomial over the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_P = U(0x9E3779B97F4A7C15)
_P_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit multiplicative hash."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class Words(NamedTuple):
    """Words of the documents lo..hi of a column. first[d]..first[d+1] are the words of document lo+d."""

    lo: int
    hi: int
    first: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    byte_first: np.ndarray
    sums: np.ndarray
    inverse: np.ndarray

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        return mix((self.sums[hi] - self.sums[lo]) * self.inverse[lo])


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n+1) and bytes of a string column; a null has no bytes."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def word_blocks(column: pa.Array, lower: bool = True, block_bytes: int = 1 << 18) -> Iterator[Words]:
    """Words of a string column, in blocks of whole documents of about block_bytes (one document at least)."""
    off, data = string_buffers(column)
    n, lo = len(column), 0
    table = _LOWER if lower else _BYTES
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + block_bytes, "right")) - 1)
        base = off[lo]
        raw = data[base : off[hi]]
        byte_first = off[lo : hi + 1] - base
        solid = ~SPACE[raw]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        cuts = byte_first[:-1][byte_first[:-1] < len(raw)]
        begin[cuts] = solid[cuts]
        stop = solid.copy()
        stop[:-1] &= ~solid[1:]
        ends = byte_first[1:][byte_first[1:] > 0] - 1
        stop[ends] = solid[ends]
        start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        power = np.full(len(raw) + 1, _P, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(table[raw] * power[:-1], out=sums[1:])
        inverse = np.full(len(raw) + 1, _P_INV, np.uint64)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        h = mix((sums[end] - sums[start]) * inverse[start])
        first = np.searchsorted(start, byte_first).astype(np.int64)
        doc = np.repeat(np.arange(hi - lo), np.diff(first))
        yield Words(lo, hi, first, doc, h, start, end, raw, byte_first, sums, inverse)
        lo = hi


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of every n-word shingle that lies in one document."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(w.doc[:m] == w.doc[n - 1 :])
    h = np.full(len(at), U(n), np.uint64)
    for j in range(n):
        h = mix(h * _P + w.hash[at + j])
    return at, h


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles per document, as (first, hashes): those of document d are hashes[first[d]:first[d+1]], ascending.

    A document with 1 to n-1 words has one shingle, its whole sequence; one without words has none.
    """
    at, h = shingles(w, n)
    doc = w.doc[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = count[short].astype(np.uint64)
        for j in range(n - 1):
            more = count[short] > j
            whole[more] = mix(whole[more] * _P + w.hash[w.first[short[more]] + j])
        doc, h = np.concatenate([doc, short]), np.concatenate([h, whole])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[keep], h[keep]
    return np.searchsorted(doc, np.arange(w.hi - w.lo + 1)), h


def set_keys(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key per set: a mix of the wrapped sums of two functions of its hashes; 0 for an empty set."""
    n = len(first) - 1
    if not len(hashes):
        return np.zeros(n, np.uint64)
    a, b = np.zeros(len(hashes) + 1, np.uint64), np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes + _P), out=a[1:])
    np.cumsum(mix(hashes ^ U(0xD6E8FEB86659FD93)), out=b[1:])
    a, b = a[first[1:]] - a[first[:-1]], b[first[1:]] - b[first[:-1]]
    return np.where(np.diff(first) > 0, mix(mix(a) * _P + b), U(0))


def same_bits(x: np.ndarray) -> np.ndarray:
    """uint64 as int64 for Spark's bigint, bits unchanged."""
    return x.view(np.int64)

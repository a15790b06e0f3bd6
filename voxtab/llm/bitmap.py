"""A bitmap of ids of fixed size, to leave out rows that a later join would drop anyway.

It errs to one side only: an id of the table is always in; others may be. The
join that follows makes the result exact, and the bitmap never grows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23


def bit_of(column: str) -> Column:
    """The bit of an id."""
    return F.pmod(F.xxhash64(column), F.lit(BITS)).cast("int")


def id_bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """1 MB with the bits of all ids of a column; at most BITS/64 numbers reach the driver."""
    at = ids.select(bit_of(column).alias("bit"))
    words = at.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits")).toPandas()
    out = np.zeros(BITS // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def has_bits(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each of these bits is set."""
    return (bitmap[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)

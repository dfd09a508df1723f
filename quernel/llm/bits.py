"""A bitmap over 64-bit hashes whose size has a fixed upper bound, for filters inside scans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS, EACH = 20, 25, 8


def bitmap(hashes: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """Bits set at the leading bits of each hash: ``EACH`` for each distinct one, at most 2 ** MOST_BITS, so never over 4 MB.

    A fuller map lets more other hashes through and never loses one.
    """
    n = hashes.select(column).distinct().count()
    bits = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(EACH * max(1, n))))))
    at = F.shiftrightunsigned(F.col(column), 64 - bits)
    rows = hashes.groupBy(F.shiftright(at, 6).alias("i")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int)))").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["i"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return out, bits


def inside(h: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
    """Which hashes the map lets through."""
    at = h >> np.uint64(64 - n)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

"""Sums of doubles that are the same to the last bit under any partitioning.

Every task adds its values up as one whole number in units of 2 ** -UNIT, so
nothing is ever rounded; values of one binary exponent are added as 64-bit
integers first.  A task hands over that number as digits of base 2 ** 32, Spark
adds digits of equal places, and the driver puts at most some two hundred sums
together.  Squares are squares of those integers: no product of doubles is made,
so they neither overflow nor lose bits.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 ** -1126 divides every double that is written as a 53-bit integer times a power of two.
UNIT, DIGIT, TOGETHER = 1126, 32, 512


def whole_number(x: np.ndarray, squares: bool = False) -> int:
    """The sum of ``x`` times 2 ** UNIT, or that of its squares times 2 ** (2 UNIT)."""
    fraction, exponent = np.frexp(x)
    number = np.ldexp(fraction, 53).astype(np.int64)
    order = np.argsort(exponent, kind="stable")
    number, exponent = number[order], exponent[order]
    starts = np.flatnonzero(np.concatenate([[True], exponent[1:] != exponent[:-1]]))
    pieces = np.concatenate([np.arange(a, b, TOGETHER) for a, b in zip(starts, np.append(starts[1:], len(x)), strict=True)])
    shifts = (exponent[pieces].astype(np.int64) - 53 + UNIT).tolist()
    add = lambda v: np.add.reduceat(v, pieces).tolist()
    if not squares:
        return sum(n << s for n, s in zip(add(number), shifts, strict=True))
    high, low = number >> 27, number & ((1 << 27) - 1)
    return sum(((a << 54) + (b << 28) + c) << (2 * s) for a, b, c, s in zip(add(high * high), add(high * low), add(low * low), shifts, strict=True))


def _digits(number: int) -> tuple[list[int], list[int]]:
    sign, number, places, digits = (1, number, [], []) if number >= 0 else (-1, -number, [], [])
    raw = np.frombuffer(number.to_bytes(-(-max(number.bit_length(), 1) // DIGIT) * 4, "little"), "<u4")
    for at in np.flatnonzero(raw).tolist():
        places.append(at)
        digits.append(sign * int(raw[at]))
    return places, digits


def exact_sums(df: DataFrame, value: str | Column, squares: bool = False) -> DataFrame:
    """(place, digit): the sum (or sum of squares) as digits of base 2 ** 32 that may have any sign and size."""
    col = F.col(value) if isinstance(value, str) else value

    def run(batches):
        total = 0
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).astype(float)
            if len(x):
                if not np.isfinite(x).all():
                    raise ValueError("sums take finite values only")
                total += whole_number(x, squares)
        if total:
            places, digits = _digits(total)
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(digits, pa.int64())], ["place", "digit"])

    parts = df.select(col.cast("double").alias("x")).filter("x is not null").mapInArrow(run, "place int, digit bigint")
    return parts.groupBy("place").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("digit"))


def exact_sum(df: DataFrame, value: str | Column, squares: bool = False) -> Fraction:
    """The sum as a fraction; ``float`` of it is correctly rounded."""
    total = sum(int(r["digit"]) << (DIGIT * r["place"]) for r in exact_sums(df, value, squares).collect())
    return Fraction(total, 1 << (2 * UNIT if squares else UNIT))

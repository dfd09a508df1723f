"""The observation table: value, status, upper, trunc_lower, trunc_upper, weight, and the checks that rows must pass.

``status`` is 1 for an exact value, 0 for one censored from the right, 2 from the
left, and 3 for an interval up to ``upper``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST_WHOLE = 9007199254740992


class CapabilityError(ValueError):
    """A combination of censoring, truncation, weights and operation that isn't supported."""


def observations(df: DataFrame, value: str, status: str | None = None, event: str | None = None, upper: str | None = None, trunc_lower: str | None = None, trunc_upper: str | None = None, weight: str | None = None) -> DataFrame:
    """Project columns of ``df`` into the table; ``event`` (boolean or 0/1) may stand for ``status``."""
    state = F.col(status) if status else F.col(event).cast("int") if event else F.lit(1)
    real = lambda c: F.col(c).cast("double") if c else F.lit(None).cast("double")
    return df.select(F.col(value).cast("double").alias("value"), state.cast("tinyint").alias("status"), real(upper).alias("upper"), real(trunc_lower).alias("trunc_lower"), real(trunc_upper).alias("trunc_upper"), (F.col(weight) if weight else F.lit(1)).cast("double").alias("weight"))


def row_code(lifetimes: bool = True) -> Column:
    """Why a row is refused; null for a sound one."""
    v, s, u, lo, hi, w = map(F.col, ("value", "status", "upper", "trunc_lower", "trunc_upper", "weight"))
    endless = lambda c: F.abs(c) == float("inf")
    window = F.coalesce(lo, F.lit(float("-inf")))
    top = F.coalesce(hi, F.lit(float("inf")))
    return (
        F.when(v.isNull(), "NULL_VALUE").when(F.isnan(v), "NAN_VALUE").when(endless(v), "NON_FINITE_VALUE").when(~s.isin(0, 1, 2, 3) | s.isNull(), "UNKNOWN_STATUS")
        .when(F.lit(lifetimes) & (v < 0), "NEGATIVE_TIME").when((s == 3) & (u.isNull() | F.isnan(u) | (u <= v)), "BAD_INTERVAL").when((s != 3) & u.isNotNull(), "UPPER_OFF_INTERVAL")
        .when(w.isNull() | (w < 0), "BAD_WEIGHT").when(window >= top, "EMPTY_WINDOW")
        .when((s == 1) & ((v < window) | (v > top)), "OUTSIDE_WINDOW").when((s == 0) & ((v < window) | (v >= top)), "OUTSIDE_WINDOW").when((s == 2) & ((v <= window) | (v > top)), "OUTSIDE_WINDOW").when((s == 3) & ((v < window) | (u > top)), "OUTSIDE_WINDOW")
    )


def violations(obs: DataFrame, lifetimes: bool = True) -> DataFrame:
    """(code, rows) of refused rows; none if the table is sound."""
    return obs.select(row_code(lifetimes).alias("code")).filter("code is not null").groupBy("code").agg(F.count("*").alias("rows"))


def numeric_violations(df: DataFrame, value: str) -> DataFrame:
    """(code, rows) by the value policy: nulls, NaN, infinities, and integers that a double can't hold."""
    c = F.col(value)
    kind = dict(df.dtypes)[value]
    if kind not in ("double", "float", "int", "bigint", "smallint", "tinyint"):
        raise CapabilityError(f"{value} is {kind}; only floating-point numbers and integers are taken")
    if kind in ("double", "float"):
        code = F.when(c.isNull(), "NULL_VALUE").when(F.isnan(c), "NAN_VALUE").when(F.abs(c) == float("inf"), "NON_FINITE_VALUE")
    else:
        code = F.when(c.isNull(), "NULL_VALUE").when((c > LARGEST_WHOLE) | (c < -LARGEST_WHOLE), "LOSSY_CAST")
    return df.select(code.alias("code")).filter("code is not null").groupBy("code").agg(F.count("*").alias("rows"))


def cell(censoring: str, truncation: str, weights: str, operation: str) -> str:
    """'supported', or the reason why a combination is refused."""
    if weights == "analytic":
        return "analytic weights are not taken"
    if operation == "log_likelihood":
        return "supported"
    if operation == "fit" and truncation == "none" and censoring in ("none", "right"):
        return "supported"
    return "supported by newton_fit only" if operation == "fit" else "unknown operation"


def assumption(obs: DataFrame) -> DataFrame:
    """One row: whether left, interval or truncated rows took part, which rests on coarsening at random."""
    odd = F.col("status").isin(2, 3) | F.col("trunc_lower").isNotNull() | F.col("trunc_upper").isNotNull()
    return obs.agg(F.coalesce(F.bool_or(odd), F.lit(False)).alias("coarsened"))

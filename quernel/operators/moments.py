"""Tests of a family by its moments, with p-values from its own samples, at any number of rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.families import family

BLOCK = 1 << 16
GAPS = ("mean_gap", "var_gap", "skew_gap", "kurt_gap")


def _gaps(s: tuple[float, ...], n: float, about: tuple[float, float, float, float]) -> np.ndarray:
    """Distances of the standardised mean, variance, skewness and kurtosis from the family's, from sums of powers of standardised values."""
    m, q, c, k = (v / n for v in s)
    var = max(q - m * m, 1e-300)
    skew = (c - 3 * m * q + 2 * m**3) / var**1.5
    kurt = (k - 4 * m * c + 6 * m * m * q - 3 * m**4) / var**2 - 3
    return np.abs(np.array([m, var, skew, kurt]) - np.array(about))


def _family_moments(name: str, params: Sequence[float], points: int = 200_001) -> tuple[float, float, float, float]:
    """Skewness and excess kurtosis by steps of equal probability; the mean and variance are 0 and 1 by standardising."""
    f = family(name)
    if f.skew and f.kurt:
        return 0.0, 1.0, float(f.skew(*params)), float(f.kurt(*params))
    q = (np.arange(points) + 0.5) / points
    z = (np.asarray(f.quantile(q, *params), float) - f.mean(*params)) / math.sqrt(f.var(*params))
    return 0.0, 1.0, float(np.mean(z**3)), float(np.mean(z**4)) - 3


def _power_sums(x) -> list[float]:
    return [float(np.sum(x**k)) for k in (1, 2, 3, 4)]


def simulated(spark, name: str, params: Sequence[float], n: int, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, s1..s4): sums of powers of standardised draws; a replicate of any n is dealt out in blocks, each with its own generator."""
    f = family(name)
    mean, sd, blocks = f.mean(*params), math.sqrt(f.var(*params)), -(-n // BLOCK)

    def run(batches):
        for b in batches:
            rows = []
            for v in b.column(0).to_pylist():
                replicate, block = divmod(v, blocks)
                size = min(BLOCK, n - block * BLOCK)
                x = (np.asarray(f.sample(np.random.default_rng([seed, replicate, block]), size, *params), float) - mean) / sd
                rows.append((replicate, *_power_sums(x)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(5)], ["replicate", "s1", "s2", "s3", "s4"])

    parts = spark.range(replicates * blocks).mapInArrow(run, "replicate bigint, s1 double, s2 double, s3 double, s4 double")
    return parts.groupBy("replicate").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(1, 5)])


def moment_test(df: DataFrame, value: str, name: str, params: Sequence[float], replicates: int = 199, seed: int = 0) -> dict:
    """Gaps of four moments and, for each, the share of the family's own samples of as many rows with a gap as large.

    Codes: OK, EMPTY_SAMPLE, NO_MOMENTS (a family without a finite variance).
    """
    f = family(name)
    mean, var = (f.mean(*params), f.var(*params)) if f.mean and f.var else (math.nan, math.nan)
    if not (math.isfinite(mean) and math.isfinite(var) and var > 0):
        return {"family": f.name, "code": "NO_MOMENTS"}
    z = (F.col(value).cast("double") - F.lit(float(mean))) / F.lit(math.sqrt(var))
    s = df.select(z.alias("z")).filter("z is not null and not isnan(z)")
    s = s.agg(F.count("*").alias("n"), *[F.sum(F.pow("z", F.lit(float(k)))).alias(f"s{k}") for k in range(1, 5)]).first()
    if not s["n"]:
        return {"family": f.name, "code": "EMPTY_SAMPLE", "n": 0}
    about, n = _family_moments(f.name, params), s["n"]
    own = _gaps(tuple(s[f"s{k}"] for k in range(1, 5)), n, about)
    rows = simulated(df.sparkSession, f.name, params, n, replicates, seed).collect()  # one for each replicate
    theirs = np.array([_gaps(tuple(r[f"s{k}"] for k in range(1, 5)), n, about) for r in rows])
    p = (1 + (theirs >= own).sum(axis=0)) / (1 + replicates)
    return {"family": f.name, "code": "OK", "n": n, **dict(zip(GAPS, map(float, own), strict=True)), "p_values": dict(zip(GAPS, map(float, p), strict=True))}

"""Refit Monte Carlo for samples of any size: a replicate is drawn in blocks that are ordered among each other.

Each block takes an equal share of probability and a number of rows that a multinomial draw gives it.  So a value's rank is known
inside of its block, and neither a task nor the driver holds a whole replicate.  The first round adds up what a refit needs; the
second draws the same blocks again and measures them against the refitted family.  A Weibull or Gumbel refit lies close to the
family drawn from, so sums of powers there give the profile's root to rounding.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.families import family

BLOCK = 65_536
CLIP = 1e-15
ORDER = 8


def _logs(x, name, p):
    """The logarithm of what is exponential under ``p``: of a Weibull's hazard, of a Gumbel's e^-z."""
    return p[0] * (np.log(x) - math.log(p[1])) if name == "weibull" else -(x - p[0]) / p[1]


def _centred(v, m):
    return [np.sum(v - m), np.sum((v - m) ** 2)]


def _powers(x, name, p):
    w = _logs(x, name, p)
    term, out = np.exp(w), [np.sum(w)]
    for _ in range(ORDER):
        out.append(np.sum(term))
        term = term * w
    return out


#: What a refit needs of a block: sums, besides least and largest value.
SUMS = {
    "exponential": lambda x, p: [np.sum(x)], "normal": lambda x, p: _centred(x, p[0]), "lognormal": lambda x, p: _centred(np.log(x), p[0]), "uniform": lambda x, p: [], "rayleigh": lambda x, p: [np.sum(x * x)],
    "pareto": lambda x, p: [np.sum(np.log(x))], "wald": lambda x, p: [np.sum(x), np.sum(1 / x)], "gamma": lambda x, p: [np.sum(x), np.sum(np.log(x))], "weibull": lambda x, p: _powers(x, "weibull", p), "gumbel": lambda x, p: _powers(x, "gumbel", p),
}


def refit(name: str, n: int, s: Sequence[float], lo: float, hi: float, p: Sequence[float]) -> tuple[float, ...]:
    """The family's estimates from the sums of a replicate that was drawn at ``p``."""
    if name == "exponential":
        return (n / s[0],)
    if name in ("normal", "lognormal"):
        d = s[0] / n
        return p[0] + d, math.sqrt(s[1] / n - d * d)
    if name == "uniform":
        return lo, hi
    if name == "rayleigh":
        return (math.sqrt(s[0] / n / 2),)
    if name == "pareto":
        return n / (s[0] - n * math.log(lo)), lo
    if name == "wald":
        return s[0] / n, 1 / (s[1] / n - n / s[0])
    if name == "gamma":
        from .fit import log_digamma_root

        k = log_digamma_root(math.log(s[0] / n) - s[1] / n)
        return k, s[0] / n / k
    mean, powers = s[0] / n, s[1:]
    at = lambda m, d: sum(powers[m + j] * d**j / math.factorial(j) for j in range(ORDER - m))
    d = 0.0
    for _ in range(50):
        r = at(1, d) / at(0, d)
        step = (1 / (1 + d) - r + mean) / (1 / (1 + d) ** 2 + at(2, d) / at(0, d) - r * r)
        d += step
        if abs(d) > 0.05:
            raise ValueError("the refit is far from the family drawn from")
        if abs(step) < 1e-15:
            break
    k, top = 1 + d, math.log(at(0, d) / n)
    return (p[0] * k, p[1] * math.exp(top / (k * p[0]))) if name == "weibull" else (p[0] - p[1] * top / k, p[1] / k)


def _dealt(spark: SparkSession, n: int, replicates: int, seed: int) -> tuple[DataFrame, int]:
    """(r, b, before, c): the blocks of all replicates, with the number of rows before and in each."""
    blocks = max(1, math.ceil(n / BLOCK))

    def run(batches):
        for frame in batches:
            for r in frame["id"]:
                c = np.random.default_rng([seed, int(r)]).multinomial(n, np.full(blocks, 1 / blocks))
                yield pd.DataFrame({"r": int(r), "b": np.arange(blocks), "before": np.cumsum(c) - c, "c": c})

    tasks = max(spark.sparkContext.defaultParallelism, min(replicates * blocks, 2000) // 8)
    return spark.range(replicates).repartition(max(1, min(replicates, tasks))).mapInPandas(run, "r long, b long, before long, c long").repartition(tasks, "r", "b"), blocks


def _drawn(name, p, seed, blocks, r, b, c) -> np.ndarray:
    u = (b + np.random.default_rng([seed, r, b + 1]).random(c)) / blocks
    return np.asarray(family(name).quantile(np.clip(u, 1e-300, 1 - 2**-53), *p), float)


def statistics(spark: SparkSession, name: str, params: Sequence[float], n: int, replicates: int, seed: int) -> DataFrame:
    """(r, ks, ad, cvm) of replicates of ``n`` rows, each drawn at ``params`` and refitted; without values where the refit fails."""
    p = tuple(map(float, params))
    frame, blocks = _dealt(spark, n, replicates, seed)

    def adds(batches):
        for batch in batches:
            out = []
            for r, b, c in zip(batch["r"], batch["b"], batch["c"], strict=True):
                if c:
                    x = _drawn(name, p, seed, blocks, r, b, c)
                    out.append((r, [float(v) for v in SUMS[name](x, p)], float(x.min()), float(x.max())))
            yield pd.DataFrame(out, columns=["r", "s", "lo", "hi"])

    parts = frame.mapInPandas(adds, "r long, s array<double>, lo double, hi double")
    width = ORDER + 1
    fits = {}
    for row in parts.groupBy("r").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(width)]).collect():  # a row for each replicate
        try:
            fits[row["r"]] = refit(name, n, [row[f"s{i}"] for i in range(width)], row["lo"], row["hi"], p)
        except (ValueError, ZeroDivisionError, OverflowError):
            fits[row["r"]] = None

    def measures(batches):
        for batch in batches:
            out = []
            for r, b, before, c in zip(batch["r"], batch["b"], batch["before"], batch["c"], strict=True):
                if c and fits[r] is not None:
                    q = family(name).cdf(np.sort(_drawn(name, p, seed, blocks, r, b, c)), *fits[r])
                    i = np.arange(before + 1, before + c + 1, dtype=float)
                    ks = max(np.max(i / n - q), np.max(q - (i - 1) / n))
                    q = np.clip(q, CLIP, 1 - CLIP)
                    ad = np.sum((2 * i - 1) * np.log(q) + (2 * (n - i) + 1) * np.log1p(-q))
                    out.append((r, float(ks), float(ad), float(np.sum(((2 * i - 1) / (2 * n) - q) ** 2))))
            yield pd.DataFrame(out, columns=["r", "ks", "ad", "cvm"])

    told = frame.mapInPandas(measures, "r long, ks double, ad double, cvm double").groupBy("r").agg(F.max("ks").alias("ks"), (-n - F.sum("ad") / n).alias("ad"), (F.sum("cvm") + 1 / (12 * n)).alias("cvm"))
    return spark.range(replicates).withColumnRenamed("id", "r").join(told, "r", "left")

"""Goodness of fit: empirical-distribution statistics, chi-square, certified bounds for very large samples, Monte Carlo."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special as sp
from ..functions.families import column, family
from ..plans.shared import ship
from . import fit
from . import replicates as parts
from .ranking import tied_ranks

CLIP = 1e-15
#: Rows up to which a replicate is drawn as a whole.
WHOLE = 100_000


def edf_statistics(df: DataFrame, value: str, name: str, params: Sequence[float]) -> DataFrame:
    """One row: n, ks, ks_plus, ks_minus, ad, cvm.  Sums over ties are closed, so each distinct value is visited once."""
    ranked, n = tied_ranks(df, value)
    n = F.lit(float(n))
    p = ranked.withColumn("p", column(name, "cdf", "x", *params))
    q = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), F.col("p")))
    a, c = F.col("before").cast("double"), F.col("c").cast("double")
    z = a + c
    odd = z * z - a * a  # sum of 2 i - 1 over the ranks of a tie
    cubes = (z * (2 * z - 1) * (2 * z + 1) - a * (2 * a - 1) * (2 * a + 1)) / 3  # sum of (2 i - 1) squared
    return p.agg(
        F.coalesce(F.max(n), F.lit(0.0)).cast("long").alias("n"),
        F.greatest(F.max(z / n - F.col("p")), F.max(F.col("p") - a / n)).alias("ks"), F.max(z / n - F.col("p")).alias("ks_plus"), F.max(F.col("p") - a / n).alias("ks_minus"),
        (-F.max(n) - F.sum(odd * F.log(q) + (2 * n * c - odd) * F.log1p(-q)) / F.max(n)).alias("ad"),
        (1 / (12 * F.max(n)) + F.sum(cubes / (4 * n * n) - odd * q / n + c * q * q)).alias("cvm"),
    )


def ks_p_value(d: float, n: int) -> float:
    """Upper tail of the limiting distribution with the usual small-sample factor."""
    r = math.sqrt(n)
    return sp.kolmogorov_sf((r + 0.12 + 0.11 / r) * d)


def ks_test(df: DataFrame, value: str, name: str, params: Sequence[float], side: str = "two", exact_rows: int = 2000) -> dict:
    """statistic, p_value, place and side of the largest distance: two, plus (sample above) or minus.

    Up to ``exact_rows`` rows the p-value is exact; beyond, it is that of the limit, with the usual factor.
    """
    ranked, n = tied_ranks(df, value)
    if not n:
        return {"n": 0, "statistic": None, "p_value": None, "place": None, "side": None}
    p = ranked.withColumn("p", column(name, "cdf", "x", *params))
    plus, minus = (F.col("before") + F.col("c")) / F.lit(float(n)) - F.col("p"), F.col("p") - F.col("before") / F.lit(float(n))
    at = p.agg(F.max(F.struct(plus.alias("d"), (-F.col("x")).alias("x"))).alias("a"), F.max(F.struct(minus.alias("d"), (-F.col("x")).alias("x"))).alias("b")).first()
    found = {"plus": (at["a"]["d"], -at["a"]["x"]), "minus": (at["b"]["d"], -at["b"]["x"])}
    which = side if side != "two" else max(found, key=lambda k: (found[k][0], k))
    d, place = found[which]
    if side == "two":
        value_ = sp.kolmogorov_exact(d, n) if n <= exact_rows else ks_p_value(d, n)
    else:
        value_ = sp.kolmogorov_one_sided(d, n) if n <= exact_rows else math.exp(-2 * n * d * d - 2 * d / 3) if d > 0 else 1.0
    return {"n": n, "statistic": d, "p_value": min(1.0, max(0.0, value_)), "place": place, "side": which}


def chi_square(df: DataFrame, value: str, name: str, params: Sequence[float], bins: int | None = None, merge: bool = True, least: float = 5.0, fitted: int | None = None) -> dict:
    """Equal-width histogram against the family; sparse neighbours are merged, or dropped if ``merge`` is off."""
    x = F.col("x")
    data = df.select(F.col(value).cast("double").alias("x")).filter("x is not null and not isnan(x)")
    s = data.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    n, lo, hi = s["n"], s["lo"], s["hi"]
    k = bins or max(5, min(20, math.ceil(1 + math.log2(max(n, 1)))))
    index = F.least(F.lit(k - 1), F.floor((x - F.lit(lo)) / F.lit((hi - lo) / k))).cast("int")
    seen = {r["b"]: r["c"] for r in data.groupBy(index.alias("b")).agg(F.count("*").alias("c")).collect()}
    edges = np.linspace(lo, hi, k + 1)
    expected = n * np.diff(family(name).cdf(edges, *params))
    groups, o, e = [], 0, 0.0
    for i in range(k):
        o, e = o + seen.get(i, 0), e + expected[i]
        if e >= least:
            groups.append((o, e))
            o, e = 0, 0.0
        elif not merge:
            o, e = 0, 0.0
    if merge and e > 0 and groups:
        groups[-1] = (groups[-1][0] + o, groups[-1][1] + e)
    stat = float(sum((o - e) ** 2 / e for o, e in groups))
    dof = max(1, len(groups) - 1 - (len(params) if fitted is None else fitted))
    return {"n": n, "bins": len(groups), "statistic": stat, "df": dof, "p_value": float(sp.chi2_sf(stat, dof))}


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, low, high, count): equal widths, the last bin closed."""
    data = df.select(F.col(value).cast("double").alias("x")).filter("x is not null and not isnan(x)")
    s = data.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    width = (s["hi"] - s["lo"]) / bins
    index = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.lit(s["lo"])) / F.lit(width))).cast("int")
    return data.groupBy(index.alias("bin")).agg(F.count("*").alias("count")).select("bin", (F.lit(s["lo"]) + F.col("bin") * F.lit(width)).alias("low"), (F.lit(s["lo"]) + (F.col("bin") + 1) * F.lit(width)).alias("high"), "count")


def regions(df: DataFrame, value: str, name: str, params: Sequence[float], k: int = 12, error: float = 1e-12) -> DataFrame:
    """(region, cnt): even regions are bins of the probability transform, odd ones the strips of +-error around edges."""
    m = 1 << k
    p = column(name, "cdf", value, *params)
    near = F.round(p * m)
    strip = (F.abs(p - near / m) <= error) & (near > 0) & (near < m)
    region = F.when(strip, 2 * near - 1).otherwise(2 * F.least(F.floor(p * m), F.lit(m - 1)))
    return df.select(region.cast("int").alias("region")).groupBy("region").agg(F.count("*").alias("cnt"))


def large_sample(df: DataFrame, value: str, name: str, params: Sequence[float], threshold: float, k: int = 12, error: float = 1e-12) -> dict:
    """Bounds that hold the KS distance, bounds of total variation over bins, and the decision against ``threshold``; one pass."""
    m = 1 << k
    counts = np.zeros(2 * m - 1, np.int64)
    for r in regions(df, value, name, params, k, error).collect():  # at most 2 ** (k + 1) rows
        counts[r["region"]] = r["cnt"]
    n = int(counts.sum())
    total = np.cumsum(counts)
    edges = np.arange(1, m) / m
    surely, possibly = total[0 : 2 * m - 2 : 2] / n, total[1 : 2 * m - 1 : 2] / n
    lower = float(max(0.0, np.max(np.maximum(surely - edges, edges - possibly)) - error))
    upper_at = np.concatenate([possibly, [1.0]]) - np.concatenate([[0.0], edges])
    under_at = np.concatenate([edges, [1.0]]) - np.concatenate([[0.0], surely])
    upper = float(min(1.0, max(np.max(upper_at), np.max(under_at)) + error))
    inner, strips = counts[0::2] / n, counts[1::2].sum() / n
    tv = float(0.5 * np.abs(inner - 1 / m).sum())
    decision = "PASS" if upper <= threshold else "FAIL" if lower > threshold else "INCONCLUSIVE"
    return {"n": n, "bins": m, "ks_lower": lower, "ks_upper": upper, "tv_lower": max(0.0, tv - strips), "tv_upper": min(1.0, tv + strips), "decision": decision}


_FAST = {
    "exponential": lambda x: (1 / x.mean(),), "normal": lambda x: (x.mean(), x.std()), "lognormal": lambda x: (np.log(x).mean(), np.log(x).std()), "uniform": lambda x: (x.min(), x.max()),
    "rayleigh": lambda x: (math.sqrt((x * x).mean() / 2),), "laplace": lambda x: (np.median(x), np.abs(x - np.median(x)).mean()), "pareto": lambda x: (len(x) / np.log(x / x.min()).sum(), x.min()), "wald": lambda x: (x.mean(), 1 / ((1 / x).mean() - 1 / x.mean())),
    "gumbel": lambda x: _gumbel(x), "weibull": lambda x: _weibull(x), "gamma": lambda x: _gamma(x), "logistic": lambda x: _logistic(x),
}


def _logistic(x):
    """Likelihood equations by Newton steps from the moments."""
    m, s = float(np.median(x)), max(float(x.std()) * math.sqrt(3) / math.pi, 1e-12)
    for _ in range(60):
        z = (x - m) / s
        t = np.tanh(z / 2)
        d = (1 - t * t) / 2
        g = np.array([t.sum(), (z * t).sum() - len(x)])
        jacobian = -np.array([[d.sum(), (z * d).sum()], [(t + z * d).sum(), (z * (t + z * d)).sum()]]) / s
        step = np.linalg.solve(jacobian, g)
        m, s = m - float(np.clip(step[0], -2 * s, 2 * s)), max(s - float(step[1]), s / 3)
        if np.max(np.abs(step)) < 1e-12 * s:
            break
    return m, s


def _weibull(x):
    w = np.log(x) - np.log(x).max()
    k = 1.2 / max(w.std(), 1e-6)
    for _ in range(60):
        e = np.exp(k * w)
        r = (w * e).sum() / e.sum()
        g = 1 / k - r + w.mean()
        k = max(k - g / (-1 / k**2 - ((w * w * e).sum() / e.sum() - r * r)), k / 3)
    return k, math.exp(np.log(x).max() + math.log(np.exp(k * w).mean()) / k)


def _gumbel(x):
    k, s = _weibull(np.exp(-(x - x.mean()) / max(x.std(), 1e-12)))
    return x.mean() - max(x.std(), 1e-12) * math.log(s), max(x.std(), 1e-12) / k


def _gamma(x):
    g = math.log(x.mean()) - np.log(x).mean()
    k = (3 - g + math.sqrt((g - 3) ** 2 + 24 * g)) / (12 * g)
    for _ in range(30):
        k = max(float(k - (math.log(k) - sp.digamma(k) - g) / (1 / k - sp.trigamma(k))), k / 4)
    return k, x.mean() / k


def small_statistics(x: np.ndarray, name: str, params) -> tuple[float, float, float]:
    """KS, AD and CvM of one small sample."""
    p = np.sort(family(name).cdf(np.sort(x), *params))
    n, i = len(p), np.arange(1, len(p) + 1)
    q = np.clip(p, CLIP, 1 - CLIP)
    return float(max(np.max(i / n - p), np.max(p - (i - 1) / n))), float(-n - np.mean((2 * i - 1) * (np.log(q) + np.log1p(-q[::-1])))), float(1 / (12 * n) + np.sum(((2 * i - 1) / (2 * n) - q) ** 2))


class RefitRefused(ValueError):
    """The sample is larger than the caller allows, or the family can't be refitted."""


def _fitted(df: DataFrame, value: str, name: str) -> tuple[float, ...]:
    """Estimates of a large sample, from aggregations."""
    if name in ("weibull", "gumbel"):
        r = fit.fit_weibull(df, value) if name == "weibull" else fit.fit_gumbel(df, value)
        names = family(name).params
    else:
        r = fit.fit_gamma(df, value).first().asDict() if name == "gamma" else fit.fit_closed(df, value, [name]).first().asDict()
        names = ("shape", "scale") if name == "gamma" else ("p1", "p2")[: len(family(name).params)]
    if any(r.get(k) is None for k in names):
        raise RefitRefused(f"{name}: {r.get('code')}")
    return tuple(float(r[k]) for k in names)


def monte_carlo(df: DataFrame, value: str, name: str, replicates: int = 200, seed: int = 0, most_rows: int | None = None, whole: int = WHOLE) -> DataFrame:
    """(statistic, value, p_value, error, failures): each replicate is drawn from the fit, refitted and measured.

    Up to ``whole`` rows a replicate is one task's work; beyond, it is drawn in blocks (``replicates.py``; not for Laplace and logistic).
    Generators depend on the seed and the numbers of replicate and block alone, so the result doesn't depend on partitions.
    Over ``most_rows`` rows, where given, the sample is refused.
    """
    ship(df.sparkSession)
    name = family(name).name
    least = whole if most_rows is None else most_rows
    rows = [r[0] for r in df.select(F.col(value).cast("double")).limit(least + 1).collect()]
    if name not in _FAST or (len(rows) > least and (most_rows is not None or name not in parts.SUMS)):
        raise RefitRefused(name)
    if len(rows) > least:
        params = _fitted(df, value, name)
        s = edf_statistics(df, value, name, params).first()
        return _weighed({k: s[k] for k in ("ks", "ad", "cvm")}, parts.statistics(df.sparkSession, name, params, s["n"], replicates, seed))
    x = np.array(rows)
    params, n = _FAST[name](x), len(x)
    seen = dict(zip(("ks", "ad", "cvm"), small_statistics(x, name, params), strict=True))

    def run(batches):
        for b in batches:
            out = []
            for r in b["id"]:
                rng = np.random.default_rng([seed, int(r)])
                try:
                    y = family(name).sample(rng, n, *params)
                    out.append((int(r), *small_statistics(y, name, _FAST[name](y))))
                except (ValueError, FloatingPointError, ZeroDivisionError):
                    out.append((int(r), None, None, None))
            yield pd.DataFrame(out, columns=["id", "ks", "ad", "cvm"])

    spark = df.sparkSession
    runs = spark.range(replicates).repartition(max(1, min(replicates, spark.sparkContext.defaultParallelism))).mapInPandas(run, "id long, ks double, ad double, cvm double")
    return _weighed(seen, runs)


def _weighed(seen: dict[str, float], runs: DataFrame) -> DataFrame:
    """Each statistic of the sample against those of the replicates."""
    ok = F.count("ks")
    stats = [F.struct(F.lit(s).alias("statistic"), F.lit(v).alias("value"), ((F.count_if(F.col(s) >= F.lit(v)) + 1) / (ok + 1)).alias("p_value")) for s, v in seen.items()]
    out = runs.agg(F.array(*stats).alias("a"), ok.alias("ok"), (F.count("*") - ok).alias("failures")).select(F.explode("a").alias("s"), "ok", "failures")
    p = F.col("s.p_value")
    return out.select("s.statistic", "s.value", p.alias("p_value"), F.sqrt(p * (1 - p) / F.col("ok")).alias("error"), "failures")

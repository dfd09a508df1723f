"""Fits that need more than sums of powers: Student's t by EM, L-moments and the generalised extreme value, the triangular peak."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special as sp
from ..plans.shared import settle
from .ranking import quantiles, running, tied_ranks

NORMAL_LIMIT = 1e8


def _finite(df: DataFrame, value: str) -> DataFrame:
    x = F.col(value).cast("double")
    return df.select(x.alias("x")).filter("x is not null and not isnan(x)")


# Student's t


def _t_sums(x: DataFrame, df_: float, centre: float, scale: float) -> dict:
    """Sums over the latent weights w = (v + 1) / (v + z^2), in one aggregation."""
    d = F.col("x") - F.lit(centre)
    z2 = (d / scale) * (d / scale)
    w = F.lit(df_ + 1) / (z2 + df_)
    return x.agg(
        F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * d).alias("wd"), F.sum(w * d * d).alias("wdd"),
        F.avg(F.log(w) - w).alias("lw"), F.sum(F.log1p(z2 / df_)).alias("tail"),
    ).first().asDict()


def _t_loglik(s: dict, v: float, scale: float) -> float:
    front = math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi) - math.log(scale)
    return s["n"] * front - (v + 1) / 2 * s["tail"]


def _t_degrees(v: float, lw: float) -> float:
    """The degrees of freedom that the latent weights ask for: a root in one number."""
    c = 1 + lw + float(sp.digamma((v + 1) / 2)) - math.log((v + 1) / 2)
    gap = lambda y: math.log(y) - float(sp.digamma(y)) + c  # noqa: E731  falls to c
    low, high = math.log(1e-3), math.log(NORMAL_LIMIT / 2)
    if gap(math.exp(high)) > 0:
        return NORMAL_LIMIT
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if gap(math.exp(mid)) > 0 else (low, mid)
    return 2 * math.exp((low + high) / 2)


def fit_student_t(df: DataFrame, value: str, degrees: float | None = None, passes: int = 300, tol: float = 1e-9) -> dict:
    """Student's t with location and scale (and degrees of freedom, unless given) by EM on latent weights, one aggregation a step.

    The scale's step divides by the sum of weights, and every third step extrapolates from the two before it; it is undone if the
    likelihood falls.  Where the fourth moment is no larger than a normal's, the likelihood falls from infinitely many degrees on:
    code NORMAL_LIMIT, with a normal's estimates and NORMAL_LIMIT degrees.
    """
    x = settle(_finite(df, value), "student")
    s = x.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"), F.kurtosis("x").alias("k")).first()
    told = lambda code, **more: {"family": "student_t", "code": code, "n": s["n"], **more}
    if not s["n"]:
        return told("EMPTY_SAMPLE")
    if s["lo"] == s["hi"]:
        return told("DEGENERATE_SAMPLE")
    if not degrees and s["k"] <= 0:
        ll = -s["n"] / 2 * (math.log(2 * math.pi) + 2 * math.log(s["sd"]) + 1)
        return told("NORMAL_LIMIT", params={"df": NORMAL_LIMIT, "location": s["m"], "scale": s["sd"]}, loglik=ll, passes=1)
    q1, med, q3 = quantiles(x, "x", (0.25, 0.5, 0.75))
    scale = (q3 - q1) / 1.45 if q3 > q1 else (s["hi"] - s["lo"]) / 10
    used, best = 0, -math.inf

    def step(u: np.ndarray) -> tuple[np.ndarray, float]:
        nonlocal used
        used += 1
        m, spread, v = u[0], math.exp(u[1]), math.exp(u[2])
        r = _t_sums(x, v, m, spread)
        shift = r["wd"] / r["w"]
        new = math.sqrt(max(r["wdd"] / r["w"] - shift * shift, 1e-300))
        return np.array([m + shift, math.log(new), u[2] if degrees else math.log(_t_degrees(v, r["lw"]))]), _t_loglik(r, v, spread)

    unit = np.array([scale, 1.0, 1.0])
    u = np.array([med, math.log(scale), math.log(degrees or 5.0)])
    while used + 3 <= passes:
        one, ll = step(u)
        if ll < best - 1e-9 * abs(best):  # the extrapolation went too far
            u = safe
            one, ll = step(u)
        best = ll
        two, _ = step(one)
        first, bend = (one - u) / unit, (two - 2 * one + u) / unit
        if np.max(np.abs((two - one) / unit)) < tol:
            u = two
            break
        length = min(max(float(np.linalg.norm(first) / max(np.linalg.norm(bend), 1e-300)), 1.0), 64.0)
        safe = two
        u = u + unit * (2 * length * first + length * length * bend)
        if u[2] > math.log(NORMAL_LIMIT) or not np.isfinite(u).all():
            u = two
    else:
        return told("OPTIMIZER_EXHAUSTED", passes=used)
    v = math.exp(u[2])
    ll = _t_loglik(_t_sums(x, v, u[0], math.exp(u[1])), v, math.exp(u[1]))
    from ..functions.families import family

    values = dict(zip(family("student_t").params, (v, float(u[0]), math.exp(u[1])), strict=True))
    return told("OK", params=values, loglik=ll, passes=used + 1)


# L-moments


def l_moments(df: DataFrame, value: str) -> DataFrame:
    """(n, l1, l2, t3, t4): sample L-moments and their ratios, from probability-weighted moments of range-dealt ranks.

    Equal values are one row; what their ranks add up to is a difference of two products.  Values count from
    their mean, so nothing cancels.  Null beyond the number of values that each needs.
    """
    ranked, n = tied_ranks(df, value)
    centre = ranked.agg((F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("m")).first()["m"]
    x, before, after = F.col("x") - F.lit(centre), F.col("before").cast("double"), (F.col("before") + F.col("c")).cast("double")

    def falling(m: Column, r: int) -> Column:
        """m (m - 1) .. (m - r) / (r + 1): the sum of j (j - 1) .. (j - r + 1) over j < m."""
        out = m
        for k in range(1, r + 1):
            out = out * (m - k)
        return out / (r + 1)

    def weighted(r: int) -> Column:
        under = 1.0
        for k in range(r + 1):
            under *= n - k
        return F.sum(x * (falling(after, r) - falling(before, r))) / under if n > r else F.lit(None).cast("double")

    b = ranked.agg(*[weighted(r).alias(f"b{r}") for r in range(4)])
    l2 = 2 * F.col("b1") - F.col("b0")
    l3, l4 = 6 * F.col("b2") - 6 * F.col("b1") + F.col("b0"), 20 * F.col("b3") - 30 * F.col("b2") + 12 * F.col("b1") - F.col("b0")
    some = F.nullif(l2, F.lit(0.0))
    return b.select(F.lit(n).cast("long").alias("n"), (F.col("b0") + F.lit(centre)).alias("l1"), l2.alias("l2"), (l3 / some).alias("t3"), (l4 / some).alias("t4"))


def gev_of(l1: float, l2: float, t3: float) -> tuple[float, float, float]:
    """(shape, location, scale) of the generalised extreme value with these L-moments; a positive shape has a heavy upper tail."""
    skew = lambda k: 2 * (math.expm1(-k * math.log(3)) / math.expm1(-k * math.log(2))) - 3 if abs(k) > 1e-12 else 2 * math.log(3) / math.log(2) - 3
    low, high = -0.999999, 60.0  # the skewness falls in k, which is minus the shape
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if skew(mid) > t3 else (low, mid)
    k = (low + high) / 2
    if abs(k) < 1e-8:
        scale = l2 / math.log(2)
        return 0.0, l1 - 0.5772156649015329 * scale, scale
    scale = l2 * k / (-math.expm1(-k * math.log(2)) * math.gamma(1 + k))
    return -k, l1 - scale * (1 - math.gamma(1 + k)) / k, scale


def fit_gev_lmoments(df: DataFrame, value: str) -> dict:
    """The generalised extreme value family by L-moments, which exist for every sample and need no start."""
    r = l_moments(df, value).first()
    told = lambda code, **more: {"family": "gev", "code": code, "n": r["n"], **more}
    if not r["n"]:
        return told("EMPTY_SAMPLE")
    if r["t3"] is None:
        return told("DEGENERATE_SAMPLE")
    from ..functions.families import family

    return told("OK", params=dict(zip(family("gev").params, gev_of(r["l1"], r["l2"], r["t3"]), strict=True)), method="lmoments")


# Triangular


def triangular_likelihood(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """(x, c, loglik): the log-likelihood of a triangle on (low, high) with its peak at each distinct value.

    It takes ln(x - low) over all smaller values and ln(high - x) over all larger ones: running sums in two
    levels over ranges of values.
    """
    x = _finite(df, value)
    counts = x.groupBy("x").agg(F.count("*").alias("c"))
    logs = {"left": F.col("c") * F.log(F.col("x") - F.lit(low)), "right": F.col("c") * F.log(F.lit(high) - F.col("x"))}
    placed = settle(counts.repartitionByRange("x").withColumns(logs).withColumn("part", F.spark_partition_id()), "triangle")
    total = placed.agg(F.sum("c").alias("n"), F.sum("right").alias("right")).first()
    n, all_right = total["n"] or 0, total["right"] or 0.0
    sums = placed
    for name in ("c", "left", "right"):
        sums = running(sums, [], "x", name, f"before_{name}")
    over = F.lit(n) - F.col("before_c") - F.col("c")
    # A value's own logarithm is the peak's, so equal values add nothing.
    rising = F.col("before_left") - F.when(F.col("before_c") > 0, F.col("before_c") * F.log(F.col("x") - F.lit(low))).otherwise(0.0)
    falling = (F.lit(all_right) - F.col("before_right") - F.col("right")) - F.when(over > 0, over * F.log(F.lit(high) - F.col("x"))).otherwise(0.0)
    return sums.select("x", "c", (F.lit(n * math.log(2 / (high - low))) + rising + falling).alias("loglik"))


def fit_triangular(df: DataFrame, value: str, low: float | None = None, high: float | None = None) -> dict:
    """The triangle's peak by likelihood, which is always at one of the values; ends as given, or just beyond the extremes by a share of 1 / n of their distance."""
    s = _finite(df, value).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    told = lambda code, **more: {"family": "triangular", "code": code, "n": s["n"], **more}
    if not s["n"]:
        return told("EMPTY_SAMPLE")
    if low is None or high is None:
        if s["lo"] == s["hi"]:
            return told("DEGENERATE_SAMPLE")
        edge = (s["hi"] - s["lo"]) / s["n"]
        low, high = s["lo"] - edge if low is None else low, s["hi"] + edge if high is None else high
    if s["lo"] <= low or s["hi"] >= high:
        return told("INVALID_SUPPORT")
    best = triangular_likelihood(df, value, low, high).agg(F.max(F.struct("loglik", (-F.col("x")).alias("below"))).alias("b")).first()["b"]
    from ..functions.families import family

    return told("OK", params=dict(zip(family("triangular").params, (float(low), -best["below"], float(high)), strict=True)), loglik=best["loglik"])

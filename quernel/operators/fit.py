"""Maximum-likelihood and moment fits.

Closed-form families need one aggregation, shared by all of them and grouped at
will.  Weibull and Gumbel have a one-dimensional profile whose sums are Column
aggregates at several candidates a pass.  All else, with censoring, truncation
and weights, goes through Newton passes: each evaluates the log-likelihood at the
points of a difference stencil inside Arrow batches, so that only a handful of
numbers per task leave the executors, and the driver does scalar algebra.

A fit's failure is a value in the ``code`` column: EMPTY_SAMPLE,
INVALID_SUPPORT, DEGENERATE_SAMPLE, NO_OBSERVED_EVENTS, UNBOUNDED_LIKELIHOOD or
OPTIMIZER_EXHAUSTED, in this order.
"""

from __future__ import annotations

import math
import time
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special as sp
from ..functions.families import EULER, family
from ..functions.likelihood import contributions
from ..plans.shared import settle
from . import score
from .ranking import grouped_quantiles, quantiles

CLOSED = ("exponential", "normal", "lognormal", "uniform", "rayleigh", "laplace", "pareto", "wald", "poisson", "geometric")
MOMENTS = ("normal", "exponential", "uniform", "gamma", "beta", "lognormal", "logistic", "gumbel", "pareto", "laplace", "rayleigh", "wald", "poisson", "geometric", "negative_binomial")


def _values(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.select(*by, F.col(value).cast("double").alias("x"))


def sufficient(df: DataFrame, value: str, by: Sequence[str] = (), order: bool = False) -> DataFrame:
    """Counts, sums and extremes from which all closed forms follow; one row, or one for each group.

    ``order`` adds med, q1 and q3, which no task has to sort a group for.
    """
    positive = F.when(_x() > 0, F.log("x"))
    out = _values(df, value, by).groupBy(*by).agg(
        F.count("x").alias("n"), F.sum("x").alias("s1"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.var_samp("x").alias("var1"),
        F.sum(_x() * _x()).alias("s2"), F.sum(positive).alias("sl"), F.avg(positive).alias("ml"), F.var_pop(positive).alias("vl"), F.var_samp(positive).alias("vl1"),
        F.sum(F.when(_x() != 0, 1 / _x())).alias("sr"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.sum(F.when((_x() < 0) | (_x() != F.floor("x")), 1).otherwise(0)).alias("odd"),
    )
    if order and by:
        out = same_groups(out, grouped_quantiles(df, value, by, {"q1": 0.25, "med": 0.5, "q3": 0.75}), by)
    elif order:
        out = out.withColumns({k: F.lit(v).cast("double") for k, v in zip(("q1", "med", "q3"), quantiles(df, value, (0.25, 0.5, 0.75)), strict=True)})
    return out


def same_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Join on group columns, where null equals null."""
    named = right.select(*[F.col(k).alias(f"_{k}") for k in by], *[c for c in right.columns if c not in by])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by]
    return left.join(named, on, how).drop(*[f"_{k}" for k in by])


def _absolute(df: DataFrame, value: str, by: Sequence[str], stats: DataFrame) -> DataFrame:
    """Adds the mean distance from the median, which takes a second pass."""
    if not by:
        med = stats.first()["med"]
        if med is None:
            return stats.withColumn("mad", F.lit(None).cast("double"))
        return stats.crossJoin(_values(df, value).agg(F.avg(F.abs(_x() - F.lit(med))).alias("mad")))
    away = same_groups(_values(df, value, by), stats.select(*by, "med"), by).groupBy(*by).agg(F.avg(F.abs(_x() - F.col("med"))).alias("mad"))
    return same_groups(stats, away, by)


def _c(name: str) -> Column:
    return F.col(name)


def _x() -> Column:
    return F.col("x")


def _nan() -> Column:
    return F.lit(None).cast("double")


def _closed_forms() -> dict[str, tuple[list[Column], Column, Column, Column]]:
    """Parameters, log-likelihood, whether the support holds, and whether the sample is degenerate."""
    n, s1, mean, var, sl, lo, hi, mad = map(_c, ("n", "s1", "mean", "var", "sl", "lo", "hi", "mad"))
    ln2pi = F.lit(math.log(2 * math.pi))
    rayleigh = F.sqrt(_c("s2") / (2 * n))
    alpha = n / (sl - n * F.log(lo))
    lam = n / (_c("sr") - n / mean)
    yes, no = F.lit(True), F.lit(False)
    return {
        "exponential": ([n / s1], n * F.log(n / s1) - n, lo >= 0, s1 <= 0),
        "normal": ([mean, F.sqrt("var")], -n / 2 * (ln2pi + F.log("var") + 1), yes, (var <= 0) | (hi <= lo)),  # squares of merged means leave a rest where values are equal
        "lognormal": ([_c("ml"), F.sqrt("vl")], -n / 2 * (ln2pi + F.log("vl") + 1) - sl, lo > 0, (_c("vl") <= 0) | (hi <= lo)),
        "uniform": ([lo, hi], -n * F.log(hi - lo), yes, hi <= lo),
        "rayleigh": ([rayleigh], sl - n * F.log(rayleigh * rayleigh) - n, lo > 0, no),
        "laplace": ([_c("med"), mad], -n * (F.log(2 * mad) + 1), yes, mad <= 0),
        "pareto": ([alpha, lo], n * F.log(alpha) + n * alpha * F.log(lo) - (alpha + 1) * sl, lo > 0, hi <= lo),
        "wald": ([mean, lam], n / 2 * (F.log(lam) - ln2pi - 1) - 1.5 * sl, lo > 0, hi <= lo),
        "poisson": ([mean], _nan(), (lo >= 0) & (_c("odd") == 0), mean <= 0),
        "geometric": ([1 / mean], n * F.log(1 / mean) + (s1 - n) * F.log(1 - 1 / mean), (lo >= 1) & (_c("odd") == 0), mean <= 1),
    }


def fit_closed(df: DataFrame, value: str, families: Sequence[str] = CLOSED, by: Sequence[str] = ()) -> DataFrame:
    """(by.., family, code, n, p1, p2, loglik, aic, bic) for closed-form families, from one aggregation (and one for Laplace)."""
    stats = sufficient(df, value, by, order="laplace" in families)
    stats = _absolute(df, value, by, stats) if "laplace" in families else stats.withColumn("mad", _nan()).withColumn("med", _nan())
    if "poisson" in families:
        factorial = _values(df, value, by).filter((_x() >= 0) & (_x() == F.floor("x"))).groupBy(*by, "x").count()
        factorial = factorial.withColumn("w", F.col("count") * _log_factorial(F.col("x"))).groupBy(*by).agg(F.sum("w").alias("lf"))
        stats = stats.crossJoin(factorial) if not by else same_groups(stats, factorial, by)
    forms, rows = _closed_forms(), []
    for name in families:
        params, loglik, holds, flat = forms[name]
        if name == "poisson":
            loglik = F.col("s1") * F.log("mean") - F.col("s1") - F.col("lf")
        code = F.when(F.col("n") == 0, "EMPTY_SAMPLE").when(~holds, "INVALID_SUPPORT").when(flat, "DEGENERATE_SAMPLE").otherwise("OK")
        good = code == "OK"
        p = [*params, *[_nan()] * (2 - len(params))]
        rows.append(F.struct(F.lit(name).alias("family"), code.alias("code"), F.lit(len(params)).alias("k"), *[F.when(good, v).alias(f"p{i + 1}") for i, v in enumerate(p)], F.when(good, loglik).alias("loglik")))
    out = stats.select(*by, "n", F.explode(F.array(*rows)).alias("f")).select(*by, "f.family", "f.code", "n", "f.k", "f.p1", "f.p2", "f.loglik")
    return out.withColumn("aic", 2 * F.col("k") - 2 * F.col("loglik")).withColumn("bic", F.col("k") * F.log("n") - 2 * F.col("loglik")).drop("k")


def _log_factorial(x: Column) -> Column:
    """ln x!: a sum of logarithms below 20, Stirling's series beyond."""
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(x, F.lit(20.0)).cast("int"))), F.lit(0.0), lambda a, k: a + F.log(k.cast("double")))
    y = x + 1
    series = (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return F.when(x <= 20, small).otherwise(series)


def fit_moments(df: DataFrame, value: str, families: Sequence[str] = MOMENTS, by: Sequence[str] = ()) -> DataFrame:
    """(by.., family, n, p1, p2) by the method of moments."""
    stats = sufficient(df, value, by, order=bool({"laplace", "cauchy"} & set(families)))
    stats = _absolute(df, value, by, stats) if "laplace" in families else stats
    if "med" not in stats.columns:
        stats = stats.withColumns({k: _nan() for k in ("q1", "med", "q3")})
    mean, var = F.col("mean"), F.col("var1")
    common = mean * (1 - mean) / var - 1
    spread = F.when(var > mean, var).otherwise(1.1 * mean)
    forms = {
        "normal": [mean, F.sqrt("var1")], "exponential": [1 / mean], "uniform": [F.col("lo"), F.col("hi")], "gamma": [mean * mean / var, var / mean],
        "beta": [F.greatest(F.lit(0.1), mean * common), F.greatest(F.lit(0.1), (1 - mean) * common)], "lognormal": [F.col("ml"), F.sqrt("vl1")], "logistic": [mean, F.sqrt("var1") * F.lit(math.sqrt(3) / math.pi)],
        "gumbel": [mean - EULER * F.sqrt("var1") * F.lit(math.sqrt(6) / math.pi), F.sqrt("var1") * F.lit(math.sqrt(6) / math.pi)], "pareto": [F.greatest(F.lit(1.01), mean / (mean - F.col("lo"))), F.col("lo")],
        "laplace": [F.col("med"), F.col("mad") if "laplace" in families else _nan()], "rayleigh": [F.sqrt(F.col("s2") / (2 * F.col("n")))], "wald": [mean, mean * mean * mean / var],
        "poisson": [mean], "geometric": [F.least(F.lit(1.0), 1 / mean)], "negative_binomial": [mean * mean / (spread - mean), mean / spread],
        "cauchy": [F.col("med"), (F.col("q3") - F.col("q1")) / 2], "triangular": [F.col("lo"), F.least(F.col("hi"), F.greatest(F.col("lo"), 3 * mean - F.col("lo") - F.col("hi"))), F.col("hi")], "chi_square": [F.greatest(mean, F.lit(1.0))],
    }
    rows = [F.struct(F.lit(f).alias("family"), *[(forms[f][i] if i < len(forms[f]) else _nan()).cast("double").alias(f"p{i + 1}") for i in range(3)]) for f in families]
    return stats.select(*by, "n", F.explode(F.array(*rows)).alias("f")).select(*by, "f.family", "n", "f.p1", "f.p2", "f.p3")


def fit_binomial(df: DataFrame, value: str, n: int | None = None) -> DataFrame:
    """(n_trials, p): trials given or the largest value, probability held within 0.001 and 0.999."""
    trials = F.lit(float(n)) if n is not None else F.max("x")
    s = _values(df, value).agg(trials.alias("n_trials"), F.avg("x").alias("m"))
    return s.select("n_trials", F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("m") / F.col("n_trials"))).alias("p"))


def fit_hypergeometric(df: DataFrame, value: str, population: int, draws: int) -> DataFrame:
    """(population, successes, draws) with successes nearest to mean * population / draws."""
    return _values(df, value).agg(F.avg("x").alias("m")).select(F.lit(population).alias("population"), F.round(F.col("m") * population / draws).cast("long").alias("successes"), F.lit(draws).alias("draws"))


def fit_exponential_censored(df: DataFrame, time: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """(by.., code, n, events, exposure, rate, mean, loglik, se): right-censored exponential fits in one aggregation."""
    s = df.select(*by, F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e")).groupBy(*by).agg(F.count("t").alias("n"), F.sum("e").alias("events"), F.sum("t").alias("exposure"), F.min("t").alias("lo"))
    code = F.when(F.col("n") == 0, "EMPTY_SAMPLE").when(F.col("events") == 0, "NO_OBSERVED_EVENTS").when(F.col("lo") < 0, "INVALID_SUPPORT").when(F.col("exposure") <= 0, "UNBOUNDED_LIKELIHOOD").otherwise("OK")
    ok = code == "OK"
    rate = F.when(ok, F.col("events") / F.col("exposure"))
    return s.select(*by, code.alias("code"), "n", "events", "exposure", rate.alias("rate"), (1 / rate).alias("mean"), (F.col("events") * F.log(rate) - F.col("events")).alias("loglik"), (rate / F.sqrt("events")).alias("se"))


def fit_gamma(df: DataFrame, value: str, by: Sequence[str] = (), steps: int = 40) -> DataFrame:
    """(by.., n, shape, scale): Newton on ln k - digamma(k) as Column arithmetic over the grouped sums; no further pass."""
    s = sufficient(df, value, by).withColumn("gap", F.log("mean") - F.col("ml"))
    g = F.col("gap")
    start = (3 - g + F.sqrt((g - 3) * (g - 3) + 24 * g)) / (12 * g)

    def step(k: Column, _: Column) -> Column:
        new = k - (F.log(k) - _digamma(k) - g) / (1 / k - _trigamma(k))
        return F.greatest(new, k / 4)

    shape = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    ok = (F.col("n") > 0) & (F.col("lo") > 0) & (g > 0)
    return s.select(*by, "n", F.when(ok, shape).alias("shape"), F.col("mean").alias("m")).select(*by, "n", "shape", (F.col("m") / F.col("shape")).alias("scale"))


def log_digamma_root(gap: float, steps: int = 60) -> float:
    """The shape at which ln shape - digamma(shape) is ``gap``."""
    k = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
    for _ in range(steps):
        new = max(float(k - (math.log(k) - sp.digamma(k) - gap) / (1 / k - sp.trigamma(k))), k / 4)
        if abs(new - k) <= 1e-15 * k:
            break
        k = new
    return k


def _shift(k: Column, f) -> Column:
    """Sum of f(k + i), i = 0..11, which moves the argument to where the series is good."""
    total = f(k)
    for i in range(1, 12):
        total = total + f(k + i)
    return total


def _digamma(k: Column) -> Column:
    x = k + 12
    y = 1 / (x * x)
    return F.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240))) - _shift(k, lambda v: 1 / v)


def _trigamma(k: Column) -> Column:
    x = k + 12
    y = 1 / (x * x)
    return 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y / 42)) + _shift(k, lambda v: 1 / (v * v))


def profile_sums(df: DataFrame, w: Column, candidates: Sequence[float]) -> DataFrame:
    """One row of s0_i, s1_i, s2_i = sums of e^(b w), w e^(b w), w^2 e^(b w) at each candidate b; w <= 0, so nothing overflows."""
    w = w.cast("double")
    terms = []
    for i, b in enumerate(candidates):
        e = F.exp(w * F.lit(float(b)))
        terms += [F.sum(e).alias(f"s0_{i}"), F.sum(w * e).alias(f"s1_{i}"), F.sum(w * w * e).alias(f"s2_{i}")]
    return df.agg(*terms)


class PassBudgetError(RuntimeError):
    """A fit needs more passes over the data than it was allowed."""


class Passes:
    """Counts passes over the data against a budget, and keeps a ledger of them."""

    def __init__(self, budget: int):
        self.budget, self.ledger = budget, []

    def run(self, what: str, frame: DataFrame) -> dict:
        """The only row of an aggregation, as one more pass."""
        if len(self.ledger) >= self.budget:
            raise PassBudgetError(f"{self.budget} passes do not suffice")
        began = time.perf_counter()
        row = self.row(what, frame)
        self.ledger.append({"pass": len(self.ledger) + 1, "what": what, "seconds": round(time.perf_counter() - began, 3)})
        return row

    def row(self, what: str, frame: DataFrame) -> dict:
        return frame.first().asDict()


def _profile_root(passes: Passes, df: DataFrame, w: Column, mean_w: float, start: float, close: float = 1e-5) -> tuple[float, float, float, float]:
    """Root b of 1/b - s1/s0 + mean(w), and the sums s0, s1 and s2 there; not numbers where none is found.

    ``start`` comes from a moment of the sample, so the first three candidates nearly
    always hold the root between them.  The next three lie around the zero of the
    cubic through both ends and their slopes.  Once a Newton step is small, it is
    taken without a pass: s0, s1 and s2 give the sum there to second order.
    """
    spread, grid, low, high = 1.5, [start / 1.5, start, start * 1.5], None, None
    while True:
        row = passes.run("profile", profile_sums(df, w, grid))
        points = []
        for i, b in enumerate(grid):
            s0, s1, s2 = (row[f"s{k}_{i}"] for k in range(3))
            r = s1 / s0
            points.append((float(b), 1 / b - r + mean_w, -1 / b**2 - (s2 / s0 - r * r), s0, s1, s2))
        low = max([p for p in points if p[1] > 0] + ([low] if low else []), default=None)
        high = min([p for p in points if p[1] <= 0] + ([high] if high else []), default=None)
        if low is None or high is None:
            spread *= spread
            if spread > 1e12:
                return math.nan, math.nan, math.nan, math.nan
            edge = high[0] if low is None else low[0]
            grid = [edge * spread ** ((-k if low is None else k) / 3) for k in (1, 2, 3)]
            continue
        best = min(low, high, key=lambda p: abs(p[1] / p[2]))
        step = -best[1] / best[2]
        if abs(step) <= close * best[0]:
            return best[0] + step, best[3] + best[4] * step + best[5] * step * step / 2, best[4] + best[5] * step, best[5]
        t = low[1] / (low[1] - high[1])
        gap = high[1] - low[1]
        cubic = low[0] * (1 + 2 * t) * (1 - t) ** 2 + high[0] * t * t * (3 - 2 * t) + gap * (t * (1 - t) ** 2 / low[2] - t * t * (1 - t) / high[2])
        target = cubic if low[0] < cubic < high[0] else best[0] + step if low[0] < best[0] + step < high[0] else math.sqrt(low[0] * high[0])
        reach = max(abs(target - best[0] - step), 1e-9 * target)
        grid = sorted({min(max(v, low[0]), high[0]) for v in (target - reach, target, target + reach)})


def fit_weibull(df: DataFrame, value: str, budget: int = 12, passes: Passes | None = None) -> dict:
    """Exact-sample Weibull fit in few passes: one pilot, then profile sums; keep ``df`` cheap to read again."""
    data, passes = _values(df, value), passes or Passes(budget)
    log = F.when(_x() > 0, F.log("x"))
    p = passes.run("pilot", data.agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg(log).alias("ml"), F.stddev_pop(log).alias("sl")))
    out = lambda code, **more: {"family": "weibull", "code": code, "n": p["n"], **more, "passes": len(passes.ledger), "ledger": passes.ledger}
    if not p["n"]:
        return out("EMPTY_SAMPLE")
    if p["lo"] <= 0:
        return out("INVALID_SUPPORT")
    if p["lo"] == p["hi"]:
        return out("DEGENERATE_SAMPLE")
    top, n = math.log(p["hi"]), p["n"]
    k, s0, s1, s2 = _profile_root(passes, data, F.log("x") - F.lit(top), p["ml"] - top, math.pi / math.sqrt(6) / max(p["sl"], 1e-9))
    if not math.isfinite(k):
        return out("BOUNDARY_SOLUTION")
    scale = math.exp(top + math.log(s0 / n) / k)
    loglik = n * (math.log(k) - k * math.log(scale)) + (k - 1) * n * p["ml"] - s0 * math.exp(k * (top - math.log(scale)))
    # With h = (x / scale)^k and u = ln h: sums of u h and u^2 h from those of the last pass, by ln shape and ln scale.
    c = math.log(n / s0)
    uh, uuh = n / s0 * (k * s1 + c * s0), n / s0 * (k * k * s2 + 2 * k * c * s1 + c * c * s0)
    return out("OK", shape=k, scale=scale, loglik=loglik, information=[[n + uuh, -k * uh], [-k * uh, k * k * n]])


def fit_gumbel(df: DataFrame, value: str, budget: int = 12, passes: Passes | None = None) -> dict:
    """Exact-sample right-Gumbel fit, by the same root on values centred and scaled."""
    data, passes = _values(df, value), passes or Passes(budget)
    p = passes.run("pilot", data.agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s")))
    out = lambda code, **more: {"family": "gumbel", "code": code, "n": p["n"], **more, "passes": len(passes.ledger), "ledger": passes.ledger}
    if not p["n"]:
        return out("EMPTY_SAMPLE")
    if p["lo"] == p["hi"]:
        return out("DEGENERATE_SAMPLE")
    n, peak = p["n"], max(abs(p["lo"] - p["m"]), abs(p["hi"] - p["m"]))
    z_low = (p["lo"] - p["m"]) / peak
    w = F.lit(z_low) - (_x() - F.lit(p["m"])) / F.lit(peak)
    b, s0, s1, s2 = _profile_root(passes, data, w, z_low, math.pi / math.sqrt(6) * peak / p["s"])
    if not math.isfinite(b):
        return out("BOUNDARY_SOLUTION")
    scale = peak / b
    location = p["m"] + peak * (z_low - math.log(s0 / n) / b)
    loglik = -n * math.log(scale) - n * (p["m"] - location) / scale - n
    # With z = (x - location) / scale and e = exp(-z): sums of z e and z^2 e likewise, by location and ln scale.
    c = math.log(s0 / n)
    ze, zze = n / s0 * (c * s0 - b * s1), n / s0 * (b * b * s2 - 2 * b * c * s1 + c * c * s0)
    return out("OK", location=location, scale=scale, loglik=loglik, information=[[n / scale**2, ze / scale], [ze / scale, n + zze]])


def power_sums(df: DataFrame, w: Column, candidates: Sequence[float], wide: int = 64) -> list[float]:
    """Sums of e^(b w) at up to some hundreds of candidates b, in aggregations of ``wide`` columns; w <= 0."""
    w, out = w.cast("double"), []
    for at in range(0, len(candidates), wide):
        part = candidates[at : at + wide]
        row = df.agg(*[F.sum(F.exp(w * F.lit(float(b)))).alias(f"s{i}") for i, b in enumerate(part)]).first()
        out += [row[f"s{i}"] for i in range(len(part))]
    return out


def grouped_by_multiplicity(obs: DataFrame) -> DataFrame:
    """Observations with equal rows as one, of the sum of their weights; the log-likelihood stays the same."""
    keys = ["value", "status", "upper", "trunc_lower", "trunc_upper"]
    return obs.groupBy(*keys).agg(F.sum("weight").alias("weight"))


def log_likelihoods(obs: DataFrame, name: str, points: Sequence[Sequence[float]]) -> tuple[int, np.ndarray]:
    """Rows, and the weighted log-likelihood of the observations at each of some parameter points, in one pass."""
    points = [tuple(map(float, p)) for p in points]

    def run(batches):
        total, n = np.zeros(len(points)), 0
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(6)]
            value, status, upper, lo, hi, weight = cols
            n += len(value)
            total += [float(np.sum(np.where(weight > 0, weight * contributions(name, p, value, status, upper, lo, hi), 0.0))) for p in points]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "t"])

    rows = obs.select(*[F.col(c).cast("double") for c in ("value", "status", "upper", "trunc_lower", "trunc_upper", "weight")])
    parts = rows.mapInArrow(run, "n bigint, t array<double>")
    out = parts.select("n", F.posexplode("t")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("t")).orderBy("pos").collect()
    return (out[0]["n"], np.array([r["t"] for r in out])) if out else (0, np.zeros(len(points)))


def exact_log_likelihood(obs: DataFrame, name: str, params: Sequence[float]) -> float:
    """The weighted log-likelihood, correctly rounded from the exact sum of its rows' contributions: the same under any partitioning."""
    from .exact import exact_sum

    def run(batches):
        for b in batches:
            value, status, upper, lo, hi, weight = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(6))
            each = np.where(weight > 0, weight * contributions(name, params, value, status, upper, lo, hi), 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(each)], ["x"])

    rows = obs.select(*[F.col(c).cast("double") for c in ("value", "status", "upper", "trunc_lower", "trunc_upper", "weight")])
    return float(exact_sum(rows.mapInArrow(run, "x double"), "x"))


def start_of(obs: DataFrame, name: str) -> list[float]:
    """First parameters, from moments of the values as if all were exact."""
    s = obs.agg(F.sum("weight").alias("w"), (F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.percentile_approx("value", [0.25, 0.5, 0.75]).alias("q"), F.avg(F.when(F.col("value") > 0, F.log("value"))).alias("ml"), F.stddev_pop(F.when(F.col("value") > 0, F.log("value"))).alias("sl"), F.stddev_pop("value").alias("sd")).first()
    m, sd, ml, sl = s["m"] or 1.0, max(s["sd"] or 1.0, 1e-12), s["ml"] or 0.0, max(s["sl"] or 1.0, 1e-3)
    v = sd * sd
    c = max(m * (1 - m) / v - 1, 0.2) if 0 < m < 1 else 1.0
    return {
        "exponential": [1 / max(m, 1e-12)], "weibull": [min(max(1.2 / sl, 0.05), 50.0), math.exp(ml + 0.5772 * sl / 1.2)], "gumbel": [m - EULER * sd * 0.78, sd * 0.78], "normal": [m, sd], "lognormal": [ml, sl], "gamma": [max(m * m / v, 1e-3), v / max(m, 1e-12)],
        "beta": [max(0.1, m * c), max(0.1, (1 - m) * c)], "logistic": [m, sd * math.sqrt(3) / math.pi], "cauchy": [s["q"][1], max((s["q"][2] - s["q"][0]) / 2, 1e-9)], "student_t": [5.0, s["q"][1], max((s["q"][2] - s["q"][0]) / 1.45, 1e-9)], "chi_square": [max(m, 0.5)],
        "f": [5.0, max(2 * m / (m - 1), 4.5) if m > 1.05 else 12.0], "laplace": [s["q"][1], max((s["q"][2] - s["q"][0]) / 1.39, 1e-9)], "rayleigh": [m / 1.2533], "wald": [m, max(m**3 / v, 1e-9)], "burr": [1.5, 2.0, max(s["q"][1], 1e-9) * 1.5], "gev": [0.1, m - 0.45 * sd, 0.78 * sd], "poisson": [m],
    }[name]


def newton_fit(obs: DataFrame, name: str, start: Sequence[float] | None = None, fixed: dict[int, float] | None = None, passes: int = 40, tol: float = 1e-7, merged: bool = False) -> dict:
    """Fit any smooth family to observations (value, status, upper, trunc_lower, trunc_upper, weight).

    Exact and right-censored rows of six families go by exact derivatives (``score.newton``), an aggregation a step.  For all else
    each pass evaluates a central-difference stencil around the current point and
    some trial points ahead.  Positive parameters move on a logarithmic scale.
    ``fixed`` holds parameters by index.  The result has the observed information
    of the free parameters on that scale; an end where the gradient isn't small or the information isn't definite is
    OPTIMIZER_EXHAUSTED.  ``merged`` adds up equal rows first, which pays where values repeat often.
    """
    f = family(name)
    obs = settle(grouped_by_multiplicity(obs), "merged") if merged else obs
    known = score.admissible(obs) if f.name in score.FAMILIES else {"other": 1}
    if known.get("n") == 0:
        return {"family": f.name, "code": "EMPTY_SAMPLE", "n": 0}
    begin = start if start is not None else start_of(obs, f.name)
    if not known["other"]:
        return score.newton(obs, f.name, begin, fixed, passes, known=known)
    now = np.array(begin, float)
    for i, v in (fixed or {}).items():
        now[i] = v
    free = [i for i in range(len(now)) if i not in (fixed or {})]
    positive = np.array(f.positive)
    to_scale = lambda p: np.where(positive, np.log(np.maximum(p, 1e-300)), p)
    from_scale = lambda u: np.where(positive, np.exp(np.minimum(u, 700)), u)
    u = to_scale(now)
    unit = np.where(positive, 1.0, np.maximum(np.abs(now), 1e-3) if not positive.any() else np.maximum(float(np.max(np.where(positive, now, 0))), 1e-6))
    h = 2e-4 * unit
    used, best, damping, info = 0, -np.inf, 1e-3, None
    d = len(free)
    while used < passes:
        offsets = [np.zeros(len(u))]
        for a in range(d):
            for s in (1, -1):
                offsets.append(np.eye(len(u))[free[a]] * h * s)
        for a in range(d):
            for b in range(a):
                for s, t in ((1, 1), (1, -1), (-1, 1), (-1, -1)):
                    offsets.append((np.eye(len(u))[free[a]] * s + np.eye(len(u))[free[b]] * t) * h)
        n, ll = log_likelihoods(obs, f.name, [from_scale(u + o) for o in offsets])
        used += 1
        if not n:
            return {"family": f.name, "code": "EMPTY_SAMPLE", "n": 0}
        if not np.isfinite(ll[0]):
            return {"family": f.name, "code": "INVALID_SUPPORT", "n": n}
        best = ll[0]
        g, H = np.zeros(d), np.zeros((d, d))
        for a in range(d):
            up, down = ll[1 + 2 * a], ll[2 + 2 * a]
            ha = h[free[a]]
            g[a], H[a, a] = (up - down) / (2 * ha), (up - 2 * ll[0] + down) / ha**2
        at = 1 + 2 * d
        for a in range(d):
            for b in range(a):
                pp, pm, mp, mm = ll[at : at + 4]
                H[a, b] = H[b, a] = (pp - pm - mp + mm) / (4 * h[free[a]] * h[free[b]])
                at += 4
        info = -H
        w, V = np.linalg.eigh(info)
        floor = max(1e-8 * np.max(np.abs(w)), 1e-12)
        step = V @ ((V.T @ g) / np.maximum(np.abs(w), floor))
        size = np.max(np.abs(step) / unit[free])
        if size < tol or abs(g @ step) < 1e-9 * max(1.0, abs(best)) ** 0.5 * 1e-2:
            break
        step *= min(1.0, 1.5 / size)
        trial = np.zeros((6, len(u)))
        trial[:, free] = step[None, :] * np.array([1.0, 0.5, 0.25, 0.1, 0.02, 1.6])[:, None]
        _, tl = log_likelihoods(obs, f.name, [from_scale(u + t) for t in trial])
        used += 1
        tl = np.where(np.isfinite(tl), tl, -np.inf)
        k = int(np.argmax(tl))
        if tl[k] <= best + 1e-12 * abs(best):
            # No trial gains: an end only if what the quadratic model promises is noise, and the top is one.
            if abs(g @ step) > 1e-6 * max(1.0, abs(best) * 1e-6) or np.min(w) <= 0:
                return {"family": f.name, "code": "OPTIMIZER_EXHAUSTED", "n": n, "passes": used}
            break
        u = u + trial[k]
    else:
        return {"family": f.name, "code": "OPTIMIZER_EXHAUSTED", "n": n, "passes": used}
    p = from_scale(u)
    return {"family": f.name, "code": "OK", "n": int(n), "params": dict(zip(f.params, map(float, p), strict=True)), "loglik": float(best), "information": info.tolist(), "free": [f.params[i] for i in free], "passes": used}

"""Sample-level operators: summaries, weights, model comparison, diagnostics, resampling, survival curves and others."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special as sp
from ..functions.families import column, family
from ..plans.shared import settle
from .fit import CLOSED, fit_closed, newton_fit, same_groups, sufficient
from .ranking import grouped_quantiles, quantiles, running_sum, tied_ranks


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, sd, median, extremes, quartiles, biased skewness and excess kurtosis, outliers by 1.5 interquartile ranges."""
    x = df.select(*by, F.col(value).cast("double").alias("x")).filter("x is not null and not isnan(x)")
    s = x.groupBy(*by).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("low"), F.max("x").alias("high"), F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurt"))
    wide = 1.5 * (F.col("q3") - F.col("q1"))
    out = (F.col("x") < F.col("q1") - wide) | (F.col("x") > F.col("q3") + wide)
    if by:
        s = same_groups(s, grouped_quantiles(x, "x", by, {"q1": 0.25, "median": 0.5, "q3": 0.75}), by)
        return same_groups(s, same_groups(x, s.select(*by, "q1", "q3"), by).groupBy(*by).agg(F.count_if(out).alias("outliers")), by)
    q = {k: F.lit(v).cast("double") for k, v in zip(("q1", "median", "q3"), quantiles(x, "x", (0.25, 0.5, 0.75)), strict=True)}
    return s.withColumns(q).crossJoin(x.withColumns({k: q[k] for k in ("q1", "q3")}).agg(F.count_if(out).alias("outliers")))  # one row by one row


def mean_interval(n: int, mean: float, sd: float, level: float = 0.95) -> tuple[float, float]:
    """Student interval of a mean."""
    half = float(sp.t_ppf(0.5 + level / 2, n - 1)) * sd / math.sqrt(n)
    return mean - half, mean + half


def suggest(df: DataFrame, value: str) -> DataFrame:
    """(place, family, why): normal always; lognormal, gamma, Weibull and exponential where all values are above 0; ``why`` also tells
    a skewness over 0.5 either way and an excess kurtosis over 1."""
    s = df.select(F.col(value).cast("double").alias("x")).filter("x is not null and not isnan(x)").agg(F.min("x").alias("lo"), F.skewness("x").alias("sk"), F.kurtosis("x").alias("ku"))
    above = F.coalesce(F.col("lo") > 0, F.lit(False))
    shape = F.concat_ws(", ", F.when(F.abs("sk") > 0.5, "skewed"), F.when(F.col("ku") > 1, "heavy tails"))
    families = F.when(above, F.array(*map(F.lit, ("normal", "lognormal", "gamma", "weibull", "exponential")))).otherwise(F.array(F.lit("normal")))
    return s.select(F.posexplode(families).alias("place", "family"), F.concat_ws(", ", F.when(above, "above 0"), F.when(shape != "", shape)).alias("why"))


# Weights


def weighted_summary(df: DataFrame, value: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean, variance, extremes and Kish's effective size; rows of weight 0 or without a finite value are left out."""
    x, w = F.col("x"), F.col("w")
    d = _weighted(df, value, weight, by)
    s = d.groupBy(*by).agg(F.count("*").alias("n"), F.sum("w").alias("sw"), (F.sum(w * x) / F.sum("w")).alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"), (F.sum("w") * F.sum("w") / F.sum(w * w)).alias("ess"))
    # Squares of distances from the mean take a second pass; sums of squares would cancel.
    centred = same_groups(d, s.select(*by, "mean"), by) if by else d.crossJoin(s.select("mean"))  # one row
    away = x - F.col("mean")
    v = centred.groupBy(*by).agg((F.sum(w * away * away) / F.sum("w")).alias("var"))
    out = same_groups(s, v, by) if by else s.crossJoin(v)  # one row by one row
    return out.select(*by, "n", "sw", "mean", "var", F.sqrt("var").alias("sd"), "low", "high", "ess")


def _weighted(df: DataFrame, value: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    d = df.select(*by, F.col(value).cast("double").alias("x"), F.col(weight).cast("double").alias("w"))
    return d.filter("w > 0 and not isnan(w) and x is not null and not isnan(x) and abs(x) < double('infinity')")


def weighted_quantiles(df: DataFrame, value: str, weight: str, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(q, value): the first value at which the running weight reaches q of all; no interpolation."""
    ranked, total = tied_ranks(_weighted(df, value, weight), "x", "w")
    reach = F.col("before") + F.col("c")
    found = ranked.agg(*[F.min(F.when(reach >= F.lit(q * total) * (1 - 1e-12), F.col("x"))).alias(f"v{i}") for i, q in enumerate(probs)])
    return found.select(F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(f"v{i}").alias("value")) for i, q in enumerate(probs)])).alias("s")).select("s.*")


def weighted_moments(df: DataFrame, value: str, weight: str) -> DataFrame:
    """(family, p1, p2) by weighted moments."""
    d = _weighted(df, value, weight)
    x, w = F.col("x"), F.col("w")
    lx = F.when(x > 0, F.log("x"))
    wl = F.when(x > 0, w)
    p = d.agg((F.sum(w * x) / F.sum("w")).alias("m"), (F.sum(w * lx) / F.sum(wl)).alias("ml")).first()
    mean, mean_log = (F.lit(p[k]).cast("double") for k in ("m", "ml"))
    s = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), (F.sum(w * (x - mean) * (x - mean)) / F.sum("w")).alias("v"), (F.sum(w * (lx - mean_log) * (lx - mean_log)) / F.sum(wl)).alias("vl"))
    s = s.withColumns({"m": mean, "ml": mean_log})
    m, v = F.col("m"), F.col("v")
    common = m * (1 - m) / v - 1
    nan = F.lit(None).cast("double")
    forms = {"normal": (m, F.sqrt(v)), "exponential": (1 / m, nan), "uniform": (F.col("lo"), F.col("hi")), "gamma": (m * m / v, v / m), "beta": (F.greatest(F.lit(0.1), m * common), F.greatest(F.lit(0.1), (1 - m) * common)), "lognormal": (F.col("ml"), F.sqrt("vl")), "logistic": (m, F.sqrt(3 * v) / F.lit(math.pi)), "gumbel": (m - 0.5772156649015329 * F.sqrt(6 * v) / F.lit(math.pi), F.sqrt(6 * v) / F.lit(math.pi)), "laplace": (m, F.sqrt(v / 2)), "rayleigh": (F.sqrt((v + m * m) / 2), nan), "poisson": (m, nan), "geometric": (F.least(F.lit(1.0), 1 / m), nan)}
    rows = [F.struct(F.lit(k).alias("family"), a.cast("double").alias("p1"), b.cast("double").alias("p2")) for k, (a, b) in forms.items()]
    return s.select(F.explode(F.array(*rows)).alias("f")).select("f.*")


# Model comparison


def compare(df: DataFrame, value: str, families: Sequence[str] = CLOSED, criterion: str = "aic", by: Sequence[str] = ()) -> DataFrame:
    """Closed-form fits with aicc, difference to the best, its label and rank; families that fail come last."""
    fits = fit_closed(df, value, families, by)
    k = (F.col("aic") + 2 * F.col("loglik")) / 2
    fits = fits.withColumn("aicc", F.when(F.col("n") > k + 1, F.col("aic") + 2 * k * (k + 1) / (F.col("n") - k - 1)))
    w = Window.partitionBy(*by)
    delta = F.col(criterion) - F.min(criterion).over(w)
    fits = fits.withColumn("delta", delta).withColumn("support", F.when(F.col("delta").isNull(), "failed").when(F.col("delta") < 2, "substantial").when(F.col("delta") < 7, "some").otherwise("little"))
    return fits.withColumn("rank", F.row_number().over(w.orderBy(F.col(criterion).asc_nulls_last(), "family")))


def adequate_best(candidates: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Of rows (family, p_value, aic), the one of least aic among those with p_value of at least the threshold; ties by name."""
    best = candidates.agg(F.min(F.when(F.col("p_value") >= threshold, F.struct("aic", "family"))).alias("b"))
    return best.select(F.when(F.col("b").isNull(), "NONE_ADEQUATE").otherwise("OK").alias("code"), "b.family", "b.aic")


def leave_one_out(df: DataFrame, value: str, name: str) -> DataFrame:
    """(family, loo): minus the sum of log densities of each value under the fit to all others, from totals less the row."""
    x = df.select(F.col(value).cast("double").alias("x")).filter("x is not null")
    y = F.log("x") if name == "lognormal" else F.col("x")
    near = x.agg(F.avg(y)).first()[0]  # sums of values far from 0 round; those of distances from about the mean don't
    t = x.agg(F.count("*").alias("n"), F.avg(y - F.lit(near)).alias("mean"), F.var_pop(y - F.lit(near)).alias("var")).first()
    n = float(t["n"])
    if n < 2:
        return x.agg(F.lit(name).alias("family"), F.lit(None).cast("double").alias("loo"))
    away = (y - F.lit(near)) - F.lit(t["mean"])  # from the common mean, so that nothing cancels
    mean = F.lit(near + t["mean"]) - away / (n - 1)
    if name == "exponential":
        term = -F.log(mean) - y / mean
    elif name in ("normal", "lognormal"):
        var = (F.lit(n * t["var"]) - away * away * (n / (n - 1))) / (n - 1)
        term = -0.5 * (F.log(2 * math.pi * var) + away * away * (n / (n - 1)) ** 2 / var) - (F.log("x") if name == "lognormal" else F.lit(0.0))
    else:
        raise ValueError("leave-one-out from totals is for exponential, normal and lognormal")
    return x.agg(F.lit(name).alias("family"), (-F.sum(term)).alias("loo"))


def best_of(df: DataFrame, value: str, families: Sequence[str], criterion: str = "aic") -> list[dict]:
    """Fits of any families, ranked; closed forms share one aggregation and the others use Newton passes."""
    from ..sources.observations import observations

    closed = [f for f in families if f in CLOSED]
    out = []
    for r in fit_closed(df, value, closed).collect() if closed else []:
        out.append({"family": r["family"], "code": r["code"], "params": dict(zip(family(r["family"]).params, [r["p1"], r["p2"]], strict=False)), "loglik": r["loglik"], "aic": r["aic"], "bic": r["bic"]})
    obs = observations(df, value)
    for f in [f for f in families if f not in CLOSED]:
        r = newton_fit(obs, f)
        k = len(r.get("params", ()))
        out.append({"family": f, "code": r["code"], "params": r.get("params"), "loglik": r.get("loglik"), "aic": 2 * k - 2 * r["loglik"] if r["code"] == "OK" else None, "bic": k * math.log(r["n"]) - 2 * r["loglik"] if r["code"] == "OK" else None})
    return sorted(out, key=lambda r: (r[criterion] is None, r[criterion] or 0.0, r["family"]))


# Diagnostics


def residuals(df: DataFrame, value: str, name: str, params: Sequence[float]) -> DataFrame:
    """The rows with quantile, Pearson, deviance and standardised residuals.

    A deviance residual is signed by the side of the mean and measured from the mode's density, so it is defined for any density.
    """
    f = family(name)
    mean, sd = f.mean(*params), math.sqrt(f.var(*params))
    top = float(f.logpdf(np.array([float(f.mode(*params))]), *params)[0]) if f.mode else 0.0
    x = F.col(value).cast("double")
    u = F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), column(name, "cdf", x, *params)))
    raw = x - F.lit(mean)
    stats = df.agg(F.avg(raw).alias("m"), F.stddev_pop(raw).alias("s")).first()
    dev = F.signum(raw) * F.sqrt(F.greatest(F.lit(0.0), 2 * (F.lit(top) - column(name, "logpdf", x, *params))))
    return df.withColumn("quantile_residual", column("normal", "ppf", u, 0.0, 1.0)).withColumn("pearson_residual", raw / sd).withColumn("deviance_residual", dev).withColumn("standard_residual", (raw - F.lit(stats["m"])) / F.lit(stats["s"]))


def influence(df: DataFrame, value: str, name: str, params: Sequence[float]) -> DataFrame:
    """The rows with leverage (density against the largest), Cook's distance, dffits and whether the distance is over 4 / n."""
    f = family(name)
    x = F.col(value).cast("double")
    d = df.withColumn("_d", column(name, "pdf", x, *params))
    s = d.agg(F.max("_d").alias("top"), F.count("*").alias("n")).first()
    z = (x - F.lit(f.mean(*params))) / math.sqrt(f.var(*params))
    lev = F.col("_d") / F.lit(s["top"])
    k = len(params)
    cook = z * z * lev / (k * F.pow(F.greatest(F.lit(1e-12), 1 - lev * 0.999999), F.lit(2.0)))
    return d.withColumn("leverage", lev).withColumn("cook", cook).withColumn("dffits", z * F.sqrt(lev / F.greatest(F.lit(1e-12), 1 - lev * 0.999999))).withColumn("influential", F.col("cook") > 4.0 / s["n"]).drop("_d")


def outliers(df: DataFrame, value: str, name: str, params: Sequence[float], method: str = "zscore", threshold: float | None = None) -> DataFrame:
    """The rows with score and outlier, by zscore (3), iqr of the model's quartiles (1.5), likelihood (a floor of ln f), or mahalanobis (chi-square at 0.99)."""
    f = family(name)
    x = F.col(value).cast("double")
    z = (x - F.lit(f.mean(*params))) / math.sqrt(f.var(*params)) if f.mean and f.var else None
    if method == "zscore":
        score, flag = F.abs(z), F.abs(z) > (threshold or 3.0)
    elif method == "mahalanobis":
        score, flag = z * z, z * z > float(threshold or sp.chi2_ppf(0.99, 1))
    elif method == "iqr":
        a, b = f.quantile(np.array([0.25, 0.75]), *params)
        reach = (threshold or 1.5) * (b - a)
        score = F.greatest(F.lit(float(a)) - x, x - F.lit(float(b)), F.lit(0.0)) / float(b - a)
        flag = (x < float(a - reach)) | (x > float(b + reach))
    elif method == "likelihood":
        floor = threshold if threshold is not None else float(np.quantile(f.logpdf(f.quantile((np.arange(2000) + 0.5) / 2000, *params), *params), 0.01))
        score = column(name, "logpdf", x, *params)
        flag = score < F.lit(floor)
    else:
        raise ValueError(method)
    return df.withColumn("score", score).withColumn("outlier", flag)


def plot_positions(df: DataFrame, value: str, name: str, params: Sequence[float]) -> DataFrame:
    """(x, c, position, theoretical, probability): data of QQ and PP plots, one row for each distinct value at its mean rank."""
    ranked, n = tied_ranks(df, value)
    pos = (F.col("before") + (F.col("c") + 1) / 2 - 0.5) / F.lit(float(n))
    return ranked.select("x", "c", pos.alias("position")).withColumn("theoretical", column(name, "ppf", F.col("position"), *params)).withColumn("probability", column(name, "cdf", "x", *params))


def qq_summary(points: DataFrame) -> DataFrame:
    """(qq_corr, pp_gap, slope, intercept) of plot positions; the worm is x less the line."""
    return points.agg(F.corr("theoretical", "x").alias("qq_corr"), F.max(F.abs(F.col("probability") - F.col("position"))).alias("pp_gap"), F.regr_slope("x", "theoretical").alias("slope"), F.regr_intercept("x", "theoretical").alias("intercept"))


def worm(points: DataFrame) -> DataFrame:
    """Plot positions with the deviation of each value from the line through them."""
    s = qq_summary(points).first()
    return points.withColumn("worm", F.col("x") - (F.lit(s["intercept"]) + F.lit(s["slope"]) * F.col("theoretical")))


# Resampling


def poisson_bootstrap(df: DataFrame, value: str, replicates: int = 200, seed: int = 0, key: str | None = None) -> DataFrame:
    """(replicate, n, mean, sd): each row counts a Poisson(1) number of times in each replicate, drawn from a hash of row and replicate.

    One pass, no copies of rows; with a ``key`` column of distinct values, the result doesn't depend on partitions.
    """
    source = F.xxhash64(F.lit(seed), F.col(key) if key else F.monotonically_increasing_id())
    pilot = df.agg(F.avg(F.col(value).cast("double"))).first()[0] or 0.0
    d = df.select((F.col(value).cast("double") - F.lit(pilot)).alias("x"), source.alias("k")).filter("x is not null")
    cuts = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    names = np.arange(replicates, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches):
        total = np.zeros((replicates, 3))
        for b in batches:
            x, k = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            terms = np.stack([np.ones(len(x)), x, x * x], axis=1)
            for i in range(0, len(x), 4096):
                h = k[i : i + 4096] + names[:, None]
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # fixed values: a published 64-bit finaliser
                    h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
                u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)
                total += np.searchsorted(cuts, u, "right") @ terms[i : i + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), *[pa.array(total[:, c].copy()) for c in range(3)]], ["replicate", "w", "s", "q"])

    each = d.mapInArrow(run, "replicate bigint, w double, s double, q double").groupBy("replicate").agg(*[F.sum(c).alias(c) for c in "wsq"])
    mean = F.col("s") / F.col("w")
    return each.select("replicate", F.col("w").cast("bigint").alias("n"), (mean + F.lit(pilot)).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("w") - mean * mean)).alias("sd"))


def bootstrap_interval(values: np.ndarray, estimate: float, level: float = 0.95, method: str = "percentile", jackknife: np.ndarray | None = None) -> tuple[float, float]:
    """Interval from replicate values: percentile, basic, student (t times the replicates' error) or bca (with jackknife values)."""
    a = (1 - level) / 2
    if method == "basic":
        low, high = np.quantile(values, [a, 1 - a])
        return float(2 * estimate - high), float(2 * estimate - low)
    if method == "student":
        half = float(sp.t_ppf(1 - a, len(values) - 1)) * float(np.std(values, ddof=1))
        return estimate - half, estimate + half
    if method == "bca":
        z0 = float(sp.norm_ppf(np.clip(np.mean(values < estimate), 1e-6, 1 - 1e-6)))
        d = jackknife.mean() - jackknife
        acc = float((d**3).sum() / (6 * max((d**2).sum(), 1e-300) ** 1.5))
        z = z0 + sp.norm_ppf(np.array([a, 1 - a]))
        low, high = np.quantile(values, sp.norm_cdf(z0 + z / (1 - acc * z)))
        return float(low), float(high)
    low, high = np.quantile(values, [a, 1 - a])
    return float(low), float(high)


def parametric_bootstrap(df: DataFrame, name: str, params: Sequence[float], n: int, replicates: int = 200, seed: int = 0) -> DataFrame:
    """(replicate, p1, p2): refits to samples of n drawn from a family with closed or quick fits; one generator for each replicate."""
    from .gof import _FAST

    def run(batches):
        for b in batches:
            out = []
            for r in b["id"]:
                x = family(name).sample(np.random.default_rng([seed, int(r)]), n, *params)
                p = [float(v) for v in _FAST[name](x)]
                out.append((int(r), p[0], p[1] if len(p) > 1 else None))
            yield pd.DataFrame(out, columns=["replicate", "p1", "p2"])

    spark = df.sparkSession
    return spark.range(replicates).repartition(max(1, min(replicates, spark.sparkContext.defaultParallelism))).mapInPandas(run, "replicate long, p1 double, p2 double")


def sample_family(df_session, name: str, params: Sequence[float], n: int, seed: int = 0, partitions: int = 8) -> DataFrame:
    """(id, x): n draws; draws of a row depend on its block of 4096 ids and the seed only."""

    def run(batches):
        for b in batches:
            for block in b["id"]:
                size = min(4096, n - int(block) * 4096)
                x = family(name).sample(np.random.default_rng([seed, int(block)]), size, *params)
                yield pd.DataFrame({"id": np.arange(size) + int(block) * 4096, "x": np.asarray(x, float)})

    blocks = -(-n // 4096)
    return df_session.range(blocks).repartition(max(1, min(blocks, partitions))).mapInPandas(run, "id long, x double")


# Others


def kaplan_meier(df: DataFrame, time: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """(by.., time, events, at_risk, survival) at each distinct time with events, by the standard count at risk.

    Times are dealt out by range, and both the counts before a time and the logarithms of the steps are summed in two levels.
    """
    g = df.select(*by, F.col(time).cast("double").alias("time"), F.col(event).cast("int").alias("e")).groupBy(*by, "time").agg(F.sum("e").alias("events"), F.count("*").alias("c"))
    placed = settle(g.repartitionByRange(*by, "time").withColumn("part", F.spark_partition_id()), "times")
    total = placed.groupBy(*by).agg(F.sum("c").alias("all"))
    before = running_sum(placed, by, "time", "c", "before")
    joined = before.crossJoin(total) if not by else before.join(total.select(*[F.col(c).alias(f"_{c}") for c in by], "all"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).drop(*[f"_{c}" for c in by])
    risk = joined.withColumn("at_risk", F.col("all") - F.col("before")).filter("events > 0")
    ends = F.col("events") == F.col("at_risk")
    steps = settle(risk.withColumn("step", F.when(ends, 0.0).otherwise(F.log1p(-F.col("events") / F.col("at_risk")))).select(*by, "time", "part", "events", "at_risk", "step"), "steps")
    done = running_sum(steps, by, "time", "step", "so_far")
    return done.select(*by, "time", "events", "at_risk", F.when(F.col("events") == F.col("at_risk"), 0.0).otherwise(F.exp(F.col("so_far") + F.col("step"))).alias("survival"))


def rolling_normal(df: DataFrame, value: str, order: Sequence[str], rows: int, by: Sequence[str]) -> DataFrame:
    """The rows with mu and sigma of the ``rows`` rows before each, within ``by``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-rows, -1)
    return df.withColumn("mu", F.avg(value).over(w)).withColumn("sigma", F.stddev_pop(value).over(w))


def normal_posterior(df: DataFrame, value: str, prior_mean: float, prior_var: float) -> DataFrame:
    """(post_mean, post_var) of a normal mean with a conjugate prior and the sample variance taken as known."""
    s = df.agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    var = 1 / (1 / F.lit(prior_var) + F.col("n") / F.col("v"))
    return s.select((var * (F.lit(prior_mean / prior_var) + F.col("n") * F.col("m") / F.col("v"))).alias("post_mean"), var.alias("post_var"))


def mixture_step(df: DataFrame, value: str, parts: Sequence[tuple[float, float, float]]) -> DataFrame:
    """(component, weight, mu, sigma, loglik) after one EM step from (weight, mu, sigma) of each component, in one aggregation; ``loglik`` is that of the old ones."""
    x = F.col(value).cast("double")
    logs = [F.lit(math.log(w) if w > 0 else -math.inf) + column("normal", "logpdf", x, m, s) for w, m, s in parts]
    most = F.array_max(F.array(*logs))  # far out all densities are 0, their ratios are not
    dens = [F.exp(v - most) for v in logs]
    total = sum(dens[1:], dens[0])
    r = [d / total for d in dens]
    away = [x - F.lit(float(m)) for _, m, _ in parts]  # from the old means, so that squares don't cancel
    aggs = [e for k, v in enumerate(r) for e in (F.sum(v).alias(f"r{k}"), F.sum(v * away[k]).alias(f"m{k}"), F.sum(v * away[k] * away[k]).alias(f"q{k}"))]
    s = df.agg(F.count(value).alias("n"), F.sum(most + F.log(total)).alias("loglik"), *aggs)
    rows = []
    for k, (_, m, _) in enumerate(parts):
        shift = F.col(f"m{k}") / F.col(f"r{k}")
        sigma = F.sqrt(F.greatest(F.lit(1e-12), F.col(f"q{k}") / F.col(f"r{k}") - shift * shift))
        rows.append(F.struct(F.lit(k).alias("component"), (F.col(f"r{k}") / F.col("n")).alias("weight"), (F.lit(float(m)) + shift).alias("mu"), sigma.alias("sigma"), F.col("loglik")))
    return s.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def mixture(df: DataFrame, value: str, components: int, steps: int = 100, tol: float = 1e-8) -> list[tuple[float, float, float]]:
    """EM of a normal mixture from quantiles; each step is one aggregation."""
    q = df.agg(F.percentile_approx(value, [(i + 0.5) / components for i in range(components)]).alias("q"), F.stddev_pop(value).alias("s")).first()
    parts = [(1 / components, m, max(q["s"] / components, 1e-9)) for m in q["q"]]
    for _ in range(steps):
        new = [(r["weight"], r["mu"], r["sigma"]) for r in mixture_step(df, value, parts).orderBy("component").collect()]
        done = max(abs(a - b) / max(1.0, abs(a)) for p, n in zip(parts, new, strict=True) for a, b in zip(p, n, strict=True)) < tol
        parts = new
        if done:
            break
    return parts


def best_mixture(df: DataFrame, value: str, most: int = 4, steps: int = 100) -> dict:
    """Of mixtures of 1 to ``most`` normals, the one of least BIC: components, parts, loglik, bic, and the BIC of each number."""
    n, seen, best = df.select(value).filter(F.col(value).isNotNull()).count(), {}, None
    for k in range(1, most + 1):
        parts = mixture(df, value, k, steps)
        loglik = mixture_step(df, value, parts).first()["loglik"]
        seen[k] = (3 * k - 1) * math.log(n) - 2 * loglik
        if best is None or seen[k] < best["bic"]:
            best = {"components": k, "parts": parts, "loglik": loglik, "bic": seen[k]}
    return {**best, "by_components": seen}


def value_at_risk(df: DataFrame, value: str, level: float, name: str, params: Sequence[float]) -> DataFrame:
    """(empirical, parametric) lower quantiles."""
    return df.sparkSession.range(1).select(F.lit(quantiles(df, value, [1 - level])[0]).cast("double").alias("empirical")).withColumn("parametric", F.lit(float(family(name).quantile(np.array([1 - level]), *params)[0])))


def shifted_exponential(df: DataFrame, value: str) -> DataFrame:
    """(shift, scale)."""
    return df.agg(F.min(value).alias("shift"), (F.avg(value) - F.min(value)).alias("scale"))


def hazard(name: str, x: str | Column, *params) -> Column:
    """Density over survival."""
    return column(name, "pdf", x, *params) / column(name, "sf", x, *params)


def moment_gaps(df: DataFrame, value: str, name: str, params: Sequence[float]) -> DataFrame:
    """(mean_gap, var_gap, skew_gap): differences of standardised moments from the family's."""
    f = family(name)
    s = sufficient(df, value).select("mean", "var", "n").crossJoin(df.agg(F.skewness(value).alias("sk")))
    sd = math.sqrt(f.var(*params))
    return s.select((F.abs(F.col("mean") - f.mean(*params)) / sd).alias("mean_gap"), F.abs(F.col("var") / sd**2 - 1).alias("var_gap"), F.abs(F.col("sk") - (f.skew(*params) if f.skew else 0.0)).alias("skew_gap"))

"""One door to fits at scale: a pass budget, a ledger, passes that survive a restart, and evidence from their sums."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special as sp
from ..functions.families import family
from ..sources.observations import CapabilityError
from ..sources.partitions import ResumeRefused, bound_job, generations, merged_sums, refreshed
from .evidence import canonical, digest, plan_text, source_digest
from .fit import Passes, fit_gumbel, fit_weibull, log_digamma_root, power_sums, sufficient

ONE_PASS, MANY = ("exponential", "normal", "lognormal", "gamma"), ("weibull", "gumbel")
LEAST_BUDGET, MOST_BUDGET = 3, 17
#: Sums beyond count, mean and extremes; the plan drops all others.
SUMS = {"exponential": (), "normal": ("var",), "lognormal": ("ml", "vl", "sl"), "gamma": ("ml",)}


class StoredPasses(Passes):
    """Passes whose sums are kept in a store; a pass that the store has isn't made again.

    A pass is known by its number and by its whole plan, with the literals of its aggregates, so only a run that asks the same is answered.
    """

    def __init__(self, budget: int, spark, store: str, identity: str, resume: bool):
        super().__init__(budget)
        self.spark, self.store, self.identity = spark, store, identity
        known = generations(spark, f"{store}/job")
        if known and not resume:
            raise ResumeRefused("STORE_IN_USE")
        if not bound_job(spark, store, identity):
            raise ResumeRefused("JOB_CHANGED")
        self.done = generations(spark, store)

    def row(self, what: str, frame: DataFrame) -> dict:
        number, asked = len(self.ledger) + 1, digest("pass", what, plan_text(frame))
        if number in self.done:
            kept = json.loads(self.spark.read.text(f"{self.store}/generation={number}").first()[0])
            if kept["asked"] == asked:
                self.reused = getattr(self, "reused", 0) + 1
                return kept["row"]
        row = frame.first().asDict()
        text = self.spark.range(1).select(F.lit(json.dumps({"asked": asked, "row": row})).alias("value"))
        text.coalesce(1).write.mode("overwrite").text(f"{self.store}/generation={number}")
        return row


def fit(df: DataFrame, value: str, name: str, pass_budget: int = 8, store: str | None = None, resume: bool = False) -> dict:
    """Exact-sample fit of exponential, normal, lognormal, gamma, Weibull or Gumbel: code, n, params, loglik, aic, bic, passes, ledger, identity.

    With a ``store``, the sums of each pass are kept there; after a failure, ``resume`` answers passes from it as
    long as family, column, plan and files (rows, where some come from memory) are the same (else JOB_CHANGED).
    ``identity`` names family, column and plan, and with a store also what the plan reads.
    """
    f = family(name)
    if f.name not in ONE_PASS + MANY:
        raise CapabilityError(f"{f.name} has no plan at scale")
    if not LEAST_BUDGET <= pass_budget <= MOST_BUDGET:
        raise ValueError(f"a pass budget is {LEAST_BUDGET} to {MOST_BUDGET}")
    source = source_digest(df) if store else digest("plan", plan_text(df))
    identity = canonical({"family": f.name, "column": value, "source": source})
    passes = StoredPasses(pass_budget, df.sparkSession, store, identity, resume) if store else Passes(pass_budget)
    if f.name in MANY:
        r = (fit_weibull if f.name == "weibull" else fit_gumbel)(df, value, passes=passes)
        out = {"code": r["code"], "n": r["n"], "params": {k: r[k] for k in f.params if k in r}, "loglik": r.get("loglik")}
        if "information" in r:
            out |= {"information": r["information"], "free": list(f.params)}
    else:
        out = _one_pass(f.name, passes.run("sums", sufficient(df, value).select("n", "mean", "lo", "hi", *SUMS[f.name])))
    k = len(f.params)
    if out["loglik"] is not None:
        out |= {"aic": 2 * k - 2 * out["loglik"], "bic": k * math.log(out["n"]) - 2 * out["loglik"]}
    return {"family": f.name, **out, "passes": len(passes.ledger), "ledger": passes.ledger, "reused": getattr(passes, "reused", 0), "identity": digest("job", identity)}


def _one_pass(name: str, s: dict) -> dict:
    n = s["n"]
    code = "EMPTY_SAMPLE" if not n else "INVALID_SUPPORT" if name != "normal" and s["lo"] < 0 or name in ("lognormal", "gamma") and s["lo"] <= 0 else "DEGENERATE_SAMPLE" if s["hi"] <= s["lo"] and name != "exponential" or s["hi"] == 0 == s["lo"] and name == "exponential" else "OK"
    if code != "OK":
        return {"code": code, "n": n, "params": {}, "loglik": None}
    if name == "exponential":
        rate = 1 / s["mean"]
        return {"code": code, "n": n, "params": {"rate": rate}, "loglik": n * math.log(rate) - n}
    if name in ("normal", "lognormal"):
        mu, var, jacobian = (s["mean"], s["var"], 0.0) if name == "normal" else (s["ml"], s["vl"], s["sl"])
        return {"code": code, "n": n, "params": {"mu": mu, "sigma": math.sqrt(var)}, "loglik": -n / 2 * (math.log(2 * math.pi * var) + 1) - jacobian}
    shape = log_digamma_root(math.log(s["mean"]) - s["ml"])
    scale = s["mean"] / shape
    return {"code": code, "n": n, "params": {"shape": shape, "scale": scale}, "loglik": (shape - 1) * n * s["ml"] - n * shape - n * shape * math.log(scale) - n * math.lgamma(shape)}


def fit_incremental(spark, path: str, column: str, name: str, store: str, recompute_changed: bool = False, allow_removed: bool = False, by_folder: bool = False) -> dict:
    """One-pass fit of exponential, normal, lognormal or gamma over all files of a path, of which only new and changed ones (``by_folder``: folders) are read.

    Codes are those of ``fit``; a store that belongs to another column is refused (JOB_CHANGED).
    """
    name = family(name).name
    if name not in ONE_PASS:
        raise CapabilityError(f"{name} takes no incremental passes")
    rows, seen = refreshed(spark, path, column, store, recompute_changed, allow_removed, by_folder)
    s = merged_sums(rows).first().asDict()
    s |= {"lo": s["low"], "hi": s["high"], "sl": s["nl"] * (s["ml"] or 0.0)}
    return {"family": name, **_one_pass(name, s), "files": seen}


def information(fitted: dict) -> dict:
    """The fit with the observed information of its parameters, from its own estimates; positive ones on the logarithmic scale.

    No fit here needs sums beyond its own: Weibull and Gumbel have theirs from their last pass.
    """
    n, name = fitted["n"], fitted["family"]
    if fitted["code"] != "OK" or "information" in fitted:
        return fitted
    if name == "exponential":
        info = [[float(n)]]
    elif name in ("normal", "lognormal"):
        info = [[n / fitted["params"]["sigma"] ** 2, 0.0], [0.0, 2.0 * n]]
    elif name == "gamma":
        a = fitted["params"]["shape"]
        info = [[n * a * a * float(sp.trigamma(a)), n * a], [n * a, n * a]]
    else:
        raise CapabilityError(f"{name} has no information here")
    return {**fitted, "information": info, "free": list(family(name).params)}


def _chebyshev(low: float, high: float, degree: int) -> np.ndarray:
    return (low + high) / 2 - (high - low) / 2 * np.cos(np.pi * np.arange(degree + 1) / degree)


class WeibullProfile:
    """The log-likelihood of a Weibull sample as a function of both parameters, from sums at some shapes.

    ln of the mean of e^(k w) is a smooth function of ln k; a polynomial through its values at Chebyshev points stands
    for it between them, and its pass also tells how far it is off in the middle of the gaps.  The degree is
    doubled, a pass each, until that moves the log-likelihood by no more than ``CLOSE``.
    """

    CLOSE, MOST_DEGREE = 1e-4, 96

    def __init__(self, df: DataFrame, value: str, fitted: dict, half: float, degree: int = 24):
        x = F.col(value).cast("double")
        self.passes = 1
        s = df.agg(F.count(x).alias("n"), F.max(F.log(x)).alias("top"), F.avg(F.log(x)).alias("m")).first()
        self.n, self.top, self.mean_log, self.shape, self.scale = s["n"], s["top"], s["m"], fitted["shape"], fitted["scale"]
        self.low, self.high = math.log(self.shape) - half, math.log(self.shape) + half
        while True:
            self.passes += 2
            self._approach(df, x, degree)
            # Sums of n terms are right to some 1e-13.
            if self.error <= max(self.CLOSE / self.n, 2e-13) or 2 * degree > self.MOST_DEGREE:
                break
            degree *= 2
        self.close = self.error * self.n <= max(10 * self.CLOSE, 2e-12 * self.n)

    def _approach(self, df: DataFrame, x: Column, degree: int) -> None:
        at = _chebyshev(self.low, self.high, degree)
        gaps = (at[1:] + at[:-1]) / 2
        sums = power_sums(df, F.log(x) - F.lit(self.top), [math.exp(v) for v in [*at, *gaps]], wide=len(at))
        logs = np.log(np.array(sums) / self.n)
        self.poly = np.polynomial.chebyshev.Chebyshev.fit(at, logs[: len(at)], degree, domain=[self.low, self.high])
        self.error = float(np.max(np.abs(self.poly(gaps) - logs[len(at) :])))

    def loglik(self, log_shape, log_scale):
        """At ln shape and ln scale."""
        k = np.exp(log_shape)
        power = np.exp(self.poly(log_shape) + k * (self.top - log_scale))
        return self.n * (log_shape - k * log_scale + (k - 1) * self.mean_log - power)

    def best(self, log_scale_of: Callable) -> tuple[float, float]:
        """Largest log-likelihood where the scale follows from the shape, and that ln shape; by a grid that narrows."""
        low, high = self.low, self.high
        for _ in range(12):
            grid = np.linspace(low, high, 41)
            values = self.loglik(grid, log_scale_of(np.exp(grid)))
            i = int(np.nanargmax(values))
            low, high = grid[max(i - 1, 0)], grid[min(i + 1, 40)]
        return float(values[i]), float(grid[i])


def weibull_intervals(df: DataFrame, value: str, fitted: dict, quantities: Sequence[tuple], level: float = 0.95, budget: int = 9) -> list[dict]:
    """Profile-likelihood intervals of a Weibull fit: ("shape",), ("scale",), ("mean",), ("quantile", q) or ("survival", t), at any size of data.

    All are read off one model of the likelihood that takes three passes; the window of shapes is doubled (three passes more)
    where an end lies outside, and what no degree brings close enough has the reason NOT_COMPUTABLE.
    """
    if fitted.get("code", "OK") != "OK":
        return [{"quantity": q[0], "reason": "NO_DATA"} for q in quantities]
    half, used = min(8 * 0.78 / math.sqrt(fitted["n"]), 1.5), 0
    while True:
        if used + 3 > budget:
            from .fit import PassBudgetError

            raise PassBudgetError("the window of shapes is not wide enough")
        model = WeibullProfile(df, value, fitted, half)
        used += model.passes
        out = [_interval(model, q, level) if model.close else None for q in quantities]
        if all(r is not None for r in out) or half >= 3:
            return [{**(r or {"quantity": q[0], "reason": "NOT_COMPUTABLE"}), "passes": used, "surrogate_error": model.error} for r, q in zip(out, quantities, strict=True)]
        half *= 2


def _interval(model: WeibullProfile, quantity: tuple, level: float) -> dict | None:
    kind, rest = quantity[0], quantity[1:]
    lgamma = lambda k: sp.lgamma(1 + 1 / k)
    # u is the quantity on a scale without bounds; ln scale follows from it and the shape.
    to = {"scale": lambda u, k: u + 0 * k, "mean": lambda u, k: u - lgamma(k)}
    if kind == "quantile":
        weight = math.log(-math.log1p(-rest[0]))
        to["quantile"] = lambda u, k: u - weight / k
    if kind == "survival":
        if rest[0] <= 0:
            return {"quantity": kind, "at": rest[0], "estimate": 1.0, "lower": 1.0, "upper": 1.0}
        to["survival"] = lambda u, k: math.log(rest[0]) - u / k  # u = ln(-ln S)
    k0, s0 = model.shape, math.log(model.scale)
    limit = float(model.loglik(math.log(k0), s0)) - float(sp.chi2_ppf(level, 1)) / 2
    if kind == "shape":
        at, back = math.log(k0), math.exp
        loss = lambda u: float(model.loglik(u, model.top + model.poly(u) / np.exp(u))) - limit
    else:
        at = {"scale": s0, "mean": s0 + float(lgamma(k0)), "quantile": s0 + (weight / k0 if kind == "quantile" else 0.0), "survival": k0 * (math.log(rest[0]) - s0) if kind == "survival" else 0.0}[kind]
        back = (lambda u: math.exp(-math.exp(u))) if kind == "survival" else math.exp
        loss = lambda u: model.best(lambda k: to[kind](u, k))[0] - limit
    ends, step = [], 3 / math.sqrt(model.n)
    for side in (-1, 1):
        a, b = at, at + side * step
        for _ in range(12):
            if kind == "shape" and not model.low < b < model.high:
                return None
            if loss(b) < 0:
                break
            a, b = b, at + 2 * (b - at)
        else:
            return None
        for _ in range(60):
            m = (a + b) / 2
            a, b = (m, b) if loss(m) >= 0 else (a, m)
        end = (a + b) / 2
        if kind != "shape":
            shape = model.best(lambda k, u=end: to[kind](u, k))[1]
            if min(shape - model.low, model.high - shape) < (model.high - model.low) * 0.02:
                return None
        ends.append(back(end))
    return {"quantity": kind, **({"at": rest[0]} if rest else {}), "estimate": back(at), "lower": min(ends), "upper": max(ends)}


def exponential_intervals(events: int, exposure: float, quantities: Sequence[tuple], level: float = 0.95) -> list[dict]:
    """Profile intervals of an exponential fit's rate, mean, quantiles and survival, all from the rate's, since each is monotone in it."""
    from .uncertainty import profile_rate

    r = profile_rate(events, exposure, level)
    out = []
    for kind, *rest in quantities:
        at = {"rate": lambda v: v, "mean": lambda v: 1 / v, "quantile": lambda v, q=rest: -math.log1p(-q[0]) / v, "survival": lambda v, q=rest: math.exp(-v * q[0])}[kind]
        ends = sorted(at(r[k]) for k in ("lower", "upper"))
        out.append({"quantity": kind, **({"at": rest[0]} if rest else {}), "estimate": at(r["estimate"]), "lower": ends[0], "upper": ends[1]})
    return out

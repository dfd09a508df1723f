"""Log-likelihood, gradient and Hessian of exact and right-censored samples as plain sums, and Newton's method on them.

One aggregation is one evaluation.  For five families it is Columns only; censored rows of gamma need the incomplete gamma
function and its derivatives by the shape, which Arrow batches give.  Parameters that are positive count on their logarithm.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special as sp
from ..functions.families import family
from ..sources.observations import CapabilityError

FAMILIES = ("exponential", "weibull", "gumbel", "normal", "lognormal", "gamma")
#: Families of x > 0; a row censored at or below 0 says nothing there.
ABOVE_ZERO = ("weibull", "lognormal", "gamma")


class SupportError(ValueError):
    """An exact row lies outside of the support."""


def admissible(obs: DataFrame) -> dict:
    """Weights of exact and censored rows, and the number of rows that no derivative here takes."""
    w, seen = F.col("weight"), F.col("status") == 1
    windows = [F.col(c).isNotNull() for c in ("trunc_lower", "trunc_upper") if c in obs.columns]
    other = ~F.col("status").isin(0, 1)
    for c in windows:
        other = other | c
    x = F.when(seen & (w > 0), F.col("value"))
    return obs.agg(
        F.count_if(w > 0).alias("n"), F.sum(F.when(w > 0, w)).cast("double").alias("mass"), F.coalesce(F.sum(F.when(seen, w)), F.lit(0)).alias("events"), F.count_if(~seen & (w > 0)).alias("censored"),
        F.count_if(F.coalesce(other, F.lit(True)) & (w > 0)).alias("other"), F.min(x).alias("low"), F.max(x).alias("high"), F.max(F.when(w > 0, F.col("value"))).alias("far"),
    ).first().asDict()


def derivatives(obs: DataFrame, name: str, params: Sequence[float], known: dict | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, gradient and Hessian at ``params``, from one pass over observations (value, status 1 or 0, weight).

    ``known`` is what ``admissible`` tells of them, if that was asked before.
    """
    return derivatives_at(obs, name, [params], known)[0]


def terms_of(name: str, params: Sequence[Column], x: Column, seen: Column) -> dict[str, Column]:
    """What one row adds at parameters that are columns: v, slopes a and b, second slopes aa, ab and bb (exponential: a, aa); of gamma d, sl and sx."""
    exact = lambda v: F.when(seen, v).otherwise(0.0)
    how = {"exponential": _exponential, "weibull": _weibull, "gumbel": _gumbel, "normal": _gauss, "lognormal": _gauss, "gamma": _gamma}
    return how[name](x, exact, seen, name, *params)


def derivatives_at(obs: DataFrame, name: str, points: Sequence[Sequence[float]], known: dict | None = None, centre: float = 0.0) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Value, gradient and Hessian at each of a few points, all from one pass; values are less ``centre`` for each unit of weight, but for gamma."""
    if name not in FAMILIES:
        raise CapabilityError(f"{name} has no closed derivatives here")
    known = known or admissible(obs)
    if known["other"]:
        raise CapabilityError("only exact rows and rows censored from the right, without windows, are taken")
    if known["low"] is not None and (known["low"] <= 0 if name in ABOVE_ZERO else name == "exponential" and known["low"] < 0):
        raise SupportError(f"an exact value is {known['low']}")
    # Points are rows of a literal table, not constants of the plan: the code compiled for one pass serves all others.
    some = points[:1] if name == "gamma" else points  # the sums of gamma's exact rows don't depend on the point
    table = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(float(v)).alias(f"p{k}") for k, v in enumerate(p)]) for i, p in enumerate(some)])
    each = obs.select("value", "weight", (F.col("status") == 1).alias("seen"), F.explode(table).alias("p"))
    x, w = F.col("value"), F.col("weight")
    x = F.when(x > 0, x) if name in (*ABOVE_ZERO, "exponential") else x  # sums leave nulls out
    total = lambda c: F.coalesce(F.sum(F.when(w > 0, w * c)), F.lit(0.0))
    at = [F.col(f"p.p{k}") for k in range(len(points[0]))]
    if name in ("normal", "lognormal"):  # once for each censored row, not in every sum
        each = each.withColumn("m", F.when(~F.col("seen"), mills(_standard(x, name, *at))))
    terms = terms_of(name, at, x, F.col("seen"))
    if centre and "v" in terms:
        terms["v"] = terms["v"] - F.lit(float(centre))
    sums = {r["i"]: r for r in each.groupBy("p.i").agg(*[total(c).alias(k) for k, c in terms.items()]).collect()}
    tails = _gamma_tails(obs, points) if name == "gamma" and known["censored"] else np.zeros((len(points), 6))
    out = []
    for i, p in enumerate(points):
        r = sums.get(0 if name == "gamma" else i) or dict.fromkeys(terms, 0.0)
        if name == "exponential":
            # An exact 0 counts as an event without exposure.
            more = known["events"] - r["d"]
            out.append((r["v"] + more * math.log(p[0]), np.array([r["a"] + more]), np.array([[r["aa"]]])))
        elif name == "gamma":
            (a, s), t = p, tails[i]
            d, sl, sx = r["d"], r["sl"], r["sx"]
            psi, tri = float(sp.digamma(a)), float(sp.trigamma(a))
            ga = sl - d * math.log(s) - d * psi
            value = (a - 1) * sl - sx / s - d * (a * math.log(s) + math.lgamma(a)) + t[0]
            g, h = np.array([a * ga, sx / s - d * a]) + t[1:3], np.array([[a * ga - a * a * d * tri, -d * a], [-d * a, -sx / s]])
            out.append((value, g, h + np.array([[t[3], t[4]], [t[4], t[5]]])))
        else:
            out.append((r["v"], np.array([r["a"], r["b"]]), np.array([[r["aa"], r["ab"]], [r["ab"], r["bb"]]])))
    return out


def _gamma_tails(obs: DataFrame, points: Sequence[Sequence[float]]) -> np.ndarray:
    """What censored rows add at each point: ln Q(a, x / s), its slopes by ln a and ln s, and the second ones (aa, as, ss)."""
    points = [tuple(map(float, p)) for p in points]

    def run(batches):
        total = np.zeros((len(points), 6))
        for b in batches:
            x, w = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(2))
            for i, (a, s) in enumerate(points):
                y = x / s
                lq, first, second = sp.log_gamma_q_slopes(a, y)
                # Q falls by g = y^(a-1) e^-y / gamma(a) in y; r = y g / Q.
                r = np.exp(sp.log_gamma_front(a, y) - lq)
                cross = r * (np.log(y) - float(sp.digamma(a)) - first)  # slope of r in a
                rows = lq, a * first, r, a * first + a * a * second, a * cross, -r * (a - y + r)
                total[i] += [float(np.sum(w * v)) for v in rows]
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["t"])

    rows = obs.filter("status = 0 and weight > 0 and value > 0").select(F.col("value").cast("double"), F.col("weight").cast("double"))
    parts = rows.mapInArrow(run, "t array<double>")
    n = 6 * len(points)
    sums = parts.agg(*[F.coalesce(F.sum(F.get("t", F.lit(i))), F.lit(0.0)).alias(f"t{i}") for i in range(n)]).first()
    return np.array(list(sums)).reshape(len(points), 6)


def newton(obs: DataFrame, name: str, start: Sequence[float], fixed: dict[int, float] | None = None, passes: int = 40, tol: float = 1e-10, known: dict | None = None) -> dict:
    """Maximum-likelihood fit by Newton steps on exact derivatives, one aggregation each; a step that loses is halved.

    Codes: OK, EMPTY_SAMPLE, NO_OBSERVED_EVENTS, INVALID_SUPPORT, UNBOUNDED_LIKELIHOOD (all events at one value, nothing beyond it) and
    OPTIMIZER_EXHAUSTED, which also stands for an end without a maximum: a gradient that is not small, or an information that is not definite.
    """
    f, fixed = family(name), fixed or {}
    known = known or admissible(obs)
    told = lambda code, **more: {"family": f.name, "code": code, "n": known["n"], **more}
    if not known["n"]:
        return told("EMPTY_SAMPLE")
    if not known["events"]:
        return told("NO_OBSERVED_EVENTS")
    if name != "exponential" and not fixed and known["low"] == known["high"] and known["far"] <= known["high"]:
        return told("UNBOUNDED_LIKELIHOOD")
    positive = np.array(f.positive)
    to_scale = lambda p: np.where(positive, np.log(np.maximum(p, 1e-300)), p)
    from_scale = lambda u: np.where(positive, np.exp(np.clip(u, -700, 700)), u)
    now = np.array(start, float)
    for i, v in fixed.items():
        now[i] = v
    free = [i for i in range(len(now)) if i not in fixed]
    u, used, step = to_scale(now), 0, None
    best = grad = info = None
    while used < passes:
        trial = u if step is None else u + step
        try:
            value, g, h = derivatives(obs, name, from_scale(trial), known)
        except SupportError:
            return told("INVALID_SUPPORT")
        used += 1
        sound = np.isfinite(value) and np.isfinite(g).all() and np.isfinite(h).all()
        if best is not None and (not sound or value < best - 1e-12 * abs(best)):
            step = step / 4
            if np.max(np.abs(step)) < 1e-14 * (1 + np.max(np.abs(u))):
                break
            continue
        if not sound:
            return told("INVALID_SUPPORT", passes=used)
        u, best, grad, info = trial, value, g[free], -h[np.ix_(free, free)]
        w, axes = np.linalg.eigh(info)
        along = axes.T @ grad
        # The gain that is left, by the quadratic model; a millionth of it moves no digit that matters.
        if np.all(w > 0) and float(np.sum(along**2 / w)) <= tol * max(1.0, tol * abs(best)):
            p = from_scale(u + _placed(axes @ (along / w), free, len(u)))
            params = dict(zip(f.params, map(float, p), strict=True))
            return told("OK", params=params, loglik=float(best + 0.5 * np.sum(along**2 / w)), information=info.tolist(), free=[f.params[i] for i in free], passes=used)
        size = np.maximum(np.abs(w), 1e-8 * np.max(np.abs(w)))
        move = axes @ (along / size)
        reach = np.where(positive[free], 1.5, 3 * np.max(np.where(positive, from_scale(u), 0)) if positive.any() else np.inf)
        step = _placed(move * min(1.0, float(np.min(reach / np.maximum(np.abs(move), 1e-300)))), free, len(u))
    return told("OPTIMIZER_EXHAUSTED", passes=used)


def _placed(move: np.ndarray, free: list[int], n: int) -> np.ndarray:
    out = np.zeros(n)
    out[free] = move
    return out


def _exponential(x: Column, exact, seen, name, rate: Column) -> dict[str, Column]:
    some = F.when(x.isNotNull(), exact(F.lit(1.0)))
    return {"v": some * F.log(rate) - rate * x, "a": some - rate * x, "aa": -rate * x, "d": some}


def _weibull(x: Column, exact, seen, name, shape: Column, scale: Column) -> dict[str, Column]:
    u = shape * F.log(x / scale)
    h = F.exp(u)
    return {"v": exact(F.log(shape) + u - F.log(x)) - h, "a": exact(1 + u) - u * h, "b": shape * (h - exact(F.lit(1.0))), "aa": exact(u) - u * h - u * u * h, "ab": shape * (h + u * h - exact(F.lit(1.0))), "bb": -shape * shape * h}


def _gumbel(x: Column, exact, seen, name, location: Column, scale: Column) -> dict[str, Column]:
    """A censored row adds ln(1 - exp(-e)), e = exp(-z), whose slope in ln e is q = e / (exp(e) - 1)."""
    z = (x - location) / scale
    e = F.exp(-z)
    q = F.when(e < 1e-8, 1 - e / 2).otherwise(e / F.expm1(e))
    bend = q * (1 - e) - q * q  # slope of q in ln e
    tail = F.log(-F.expm1(-e))
    first = F.when(seen, 1 - e).otherwise(q)  # slope in -z
    second = F.when(seen, -e).otherwise(bend)  # slope of the slope in z
    # z falls by 1 / scale with the location, and by z with ln scale.
    return {
        "v": F.when(seen, -z - e - F.log(scale)).otherwise(tail), "a": first / scale, "b": F.when(seen, first * z - 1).otherwise(first * z),
        "aa": second / (scale * scale), "ab": (second * z - first) / scale, "bb": second * z * z - first * z,
    }


def _standard(x: Column, name: str, mu: Column, sigma: Column) -> Column:
    return ((F.log(x) if name == "lognormal" else x) - mu) / sigma


def _gauss(x: Column, exact, seen, name, mu: Column, sigma: Column) -> dict[str, Column]:
    """Normal, or lognormal on ln x; ``m`` is the hazard of a censored row's tail, from ``mills``."""
    z, m = _standard(x, name, mu, sigma), F.col("m")
    bend = m * (m - z)
    logs = -0.5 * z * z - F.log(sigma) - 0.5 * math.log(2 * math.pi) - (F.log(x) if name == "lognormal" else F.lit(0.0))
    tail = -0.5 * z * z - 0.5 * math.log(2 * math.pi) - F.log(m)
    first, second = F.when(seen, z).otherwise(m), F.when(seen, F.lit(1.0)).otherwise(bend)
    return {
        "v": F.when(seen, logs).otherwise(tail), "a": first / sigma, "b": F.when(seen, z * z - 1).otherwise(m * z),
        "aa": -second / (sigma * sigma), "ab": -(first + second * z) / sigma, "bb": -(second * z * z + first * z),
    }


def mills(z: Column) -> Column:
    """Normal density over the upper tail as a Column: rational approximations of the error function, without loops over rows."""
    t = z / math.sqrt(2)
    y = F.abs(t)
    density = F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    v = 1 / (y * y)
    # e^(y^2) erfc(y), of which far out a series remains
    scaled = F.when(y <= 4, sp.ratio(sp.ERFC_MIDDLE, y)).otherwise((1 / math.sqrt(math.pi) - v * sp.ratio(sp.ERFC_FAR, v)) / y)
    middle = density / (0.5 - 0.5 * t * sp.ratio(sp.ERF_LOW, t * t))
    return F.when(y <= 0.46875, middle).when(z > 0, math.sqrt(2 / math.pi) / scaled).otherwise(density / (1 - 0.5 * F.exp(-y * y) * scaled))


def _gamma(x: Column, exact, seen, name, shape: Column, scale: Column) -> dict[str, Column]:
    return {"d": exact(F.lit(1.0)), "sl": exact(F.log(x)), "sx": exact(x)}  # of exact rows; _gamma_tail has the rest

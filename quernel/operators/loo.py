"""Leave-one-out likelihood of two-parameter families without a refit for each row.

At the top of the whole sample the gradient without row i is minus the row's own.  One Newton step, with the Hessian of all
others, and a second one, from the third derivatives of the sample, lead to the top without it; the row's log density is
taken there.  All of this is arithmetic of Columns on the row's own slopes: one scan, whatever the number of rows.  The
second step's size against the first tells what is left; rows where that is over a tolerance, few and far out,
are refitted exactly, many at once in each pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special as sp
from ..functions.families import family
from . import score
from .fit import newton_fit
from .profile import TOGETHER, exact

FAMILIES = ("weibull", "gamma", "lognormal", "normal", "gumbel")


def _parts(name: str, params: Sequence[float]) -> dict[str, Column]:
    """Slopes of one exact row at fixed parameters."""
    x, yes = F.col("value"), F.lit(True)
    if name != "gamma":
        return score.terms_of(name, [F.lit(float(p)) for p in params], x, yes)
    a, s = params
    ga = F.log(x) - F.lit(math.log(s) + float(sp.digamma(a)))
    return {"a": a * ga, "b": x / s - a, "aa": a * ga - a * a * float(sp.trigamma(a)), "ab": F.lit(-float(a)), "bb": -x / s}


def _density(name: str, params: Sequence[float], da: Column, db: Column) -> Column:
    """Log density of a row at parameters moved by da and db on the fit's scale."""
    x, (p, q) = F.col("value"), params
    if name in ("normal", "lognormal"):
        y = F.log(x) if name == "lognormal" else x
        z = (y - (p + da)) / (q * F.exp(db))
        return -0.5 * z * z - (math.log(q) + db) - 0.5 * math.log(2 * math.pi) - (F.log(x) if name == "lognormal" else F.lit(0.0))
    if name == "gumbel":
        z = (x - (p + da)) / (q * F.exp(db))
        return -z - F.exp(-z) - (math.log(q) + db)
    if name == "weibull":
        k = p * F.exp(da)
        u = k * (F.log(x) - math.log(q) - db)
        return math.log(p) + da + u - F.log(x) - F.exp(u)
    # ln gamma(a e^d) by its series in the step a (e^d - 1), which is small.
    step = p * F.expm1(da)
    psi, tri = float(sp.digamma(p)), float(sp.trigamma(p))
    h = 1e-3 * p
    bend = (float(sp.trigamma(p + h)) - float(sp.trigamma(p - h))) / (2 * h)
    lgamma = math.lgamma(p) + step * (psi + step * (tri / 2 + step * bend / 6))
    a = p + step
    return (a - 1) * F.log(x) - x / q * F.exp(-db) - a * (math.log(q) + db) - lgamma


def _third(obs: DataFrame, name: str, params: Sequence[float], known: dict, hessian: np.ndarray) -> np.ndarray:
    """Third derivatives of the whole log-likelihood, by differences of Hessians at four points from one pass."""
    positive = np.array(family(name).positive)
    u = np.where(positive, np.log(np.where(positive, params, 1)), params)
    h = 0.02 / np.sqrt(np.maximum(-np.diag(hessian) / known["n"], 1e-300)) * np.ones(2)
    points = [u + s * h * np.eye(2)[i] for i in range(2) for s in (1, -1)]
    got = score.derivatives_at(obs, name, [np.where(positive, np.exp(p), p) for p in points], known)
    slope = [(got[2 * i][2] - got[2 * i + 1][2]) / (2 * h[i]) for i in range(2)]
    return np.array(slope)


def scored_rows(df: DataFrame, value: str, fitted: dict) -> DataFrame:
    """(value, lpd, left): each row's log density under the fit to all others, and about how much the two steps leave."""
    name = fitted["family"]
    params = [fitted["params"][k] for k in family(name).params]
    obs = exact(df, value).filter("value is not null and not isnan(value)")
    known = score.admissible(obs)
    _, _, hess = score.derivatives(obs, name, params, known)
    t = _third(obs, name, params, known, hess)
    bare = obs.withColumn("m", F.lit(None).cast("double"))  # no row is censored, so none has a tail
    rows = bare.select("value", *[c.alias(k) for k, c in _parts(name, params).items() if k in ("a", "b", "aa", "ab", "bb")])
    a, b, saa, sab, sbb = (F.col(k) for k in ("a", "b", "aa", "ab", "bb"))
    haa, hab, hbb = hess[0, 0] - saa, hess[0, 1] - sab, hess[1, 1] - sbb
    det = haa * hbb - hab * hab
    solve = lambda v, w: ((hbb * v - hab * w) / det, (haa * w - hab * v) / det)
    first = solve(a, b)
    rows = rows.withColumns({"da": first[0], "db": first[1]})
    da, db = F.col("da"), F.col("db")
    # Third derivatives of all others, along the first step; a row's own share is a part in n of the sample's.
    bend = [0.5 * (t[0][i, 0] * da * da + (t[0][i, 1] + t[1][i, 0]) * da * db + t[1][i, 1] * db * db) for i in range(2)]
    second = solve(-bend[0], -bend[1])
    rows = rows.withColumns({"ea": second[0], "eb": second[1]})
    one = da * da * -hess[0, 0] - 2 * da * db * hess[0, 1] + db * db * -hess[1, 1]
    two = F.col("ea") * F.col("ea") * -hess[0, 0] - 2 * F.col("ea") * F.col("eb") * hess[0, 1] + F.col("eb") * F.col("eb") * -hess[1, 1]
    # A third step would be as much smaller than the second as that is than the first; besides, the second one
    # leaves out the row's own third derivatives, whose share is about that of its second ones.
    share = F.greatest(F.abs(saa / haa), F.abs(sbb / hbb))
    left = two + F.sqrt(one * two) * share
    lpd = _density(name, params, da + F.col("ea"), db + F.col("eb"))
    return rows.select("value", lpd.alias("lpd"), F.when(det > 0, left).otherwise(F.lit(math.inf)).alias("left"))


def _own(name: str, v: float, p: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of one exact value, by numbers."""
    a, s = p
    if name == "gamma":
        ga = math.log(v / s) - float(sp.digamma(a))
        return np.array([a * ga, v / s - a]), np.array([[a * ga - a * a * float(sp.trigamma(a)), -a], [-a, -v / s]])
    if name == "weibull":
        u = a * math.log(v / s)
        h = math.exp(u)
        return np.array([1 + u - u * h, a * (h - 1)]), np.array([[u - u * h - u * u * h, a * (h + u * h - 1)], [a * (h + u * h - 1), -a * a * h]])
    z = ((math.log(v) if name == "lognormal" else v) - a) / s
    if name == "gumbel":
        e = math.exp(-z)
        f, g = 1 - e, -e
        return np.array([f / s, f * z - 1]), np.array([[g / s**2, (g * z - f) / s], [(g * z - f) / s, g * z * z - f * z]])
    return np.array([z / s, z * z - 1]), np.array([[-1 / s**2, -2 * z / s], [-2 * z / s, -2 * z * z]])


def refitted(obs: DataFrame, name: str, start: Sequence[float], values: Sequence[float], known: dict) -> list[float]:
    """Log density of each value under the fit to all other rows, exactly: Newton for ``TOGETHER`` of them in each pass."""
    f = family(name)
    positive = np.array(f.positive)
    u0 = np.where(positive, np.log(np.where(positive, start, 1)), start)
    natural = lambda u: np.where(positive, np.exp(u), u)
    out = []
    for at in range(0, len(values), TOGETHER):
        part = list(values[at : at + TOGETHER])
        us, done = [u0.copy() for _ in part], [False] * len(part)
        for _ in range(30):
            todo = [k for k, d in enumerate(done) if not d]
            if not todo:
                break
            for k, (_, g, h) in zip(todo, score.derivatives_at(obs, name, [natural(us[k]) for k in todo], known), strict=True):
                og, oh = _own(name, part[k], natural(us[k]))
                step = np.linalg.solve(h - oh, -(g - og))
                us[k] = us[k] + step * min(1.0, 1.0 / max(float(np.max(np.abs(step) / np.where(positive, 1, natural(u0)[positive].max()))), 1e-300))
                done[k] = bool(np.max(np.abs(step)) < 1e-10 * (1 + np.max(np.abs(us[k]))))
        out += [float(np.asarray(f.logpdf(np.array([v]), *natural(u)))[0]) for v, u in zip(part, us, strict=True)]
    return out


def leave_one_out(df: DataFrame, value: str, name: str, tol: float = 1e-7, most_refits: int = 1200) -> dict:
    """Minus the leave-one-out log-likelihood of a family: code, n, loo, refits.

    Rows over ``tol`` are refitted exactly; if there were more than ``most_refits``, the fit is refused (TOO_MANY_REFITS), not cut short.
    """
    fitted = newton_fit(obs := exact(df, value).filter("value is not null and not isnan(value)"), name)
    if fitted["code"] != "OK":
        return {"family": name, "code": fitted["code"], "n": fitted.get("n", 0)}
    if name not in FAMILIES:
        raise score.CapabilityError(f"{name} has no one-step leave-one-out")
    rows = scored_rows(df, value, fitted)
    over = F.coalesce(F.col("left") > tol, F.lit(True)) | F.isnan("left")
    s = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(~over, F.col("lpd"))), F.lit(0.0)).alias("lpd"), F.count_if(over).alias("far")).first()
    if s["far"] > most_refits:
        return {"family": name, "code": "TOO_MANY_REFITS", "n": s["n"], "refits": s["far"]}
    counts = {r["value"]: r["count"] for r in rows.filter(over).groupBy("value").count().collect()} if s["far"] else {}
    params = [fitted["params"][k] for k in family(name).params]
    again = refitted(obs, name, params, list(counts), score.admissible(obs)) if counts else []
    return {"family": name, "code": "OK", "n": s["n"], "loo": -(s["lpd"] + sum(c * v for c, v in zip(counts.values(), again, strict=True))), "refits": s["far"], "params": fitted["params"]}

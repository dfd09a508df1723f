"""Standard errors and intervals from a fit's information, exact and profile intervals, and derived quantities."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from ..functions import special as sp
from ..functions.families import family


class Unavailable(dict):
    """A reason in place of an interval: NO_DATA, FIXED_PARAMETER, SINGULAR_INFORMATION, NOT_POSITIVE_DEFINITE, NOT_COMPUTABLE."""

    def __init__(self, reason: str):
        super().__init__(reason=reason)


def covariance(fit: dict) -> np.ndarray | Unavailable:
    """Inverse of the observed information, on the scale that the fit moved on."""
    if fit.get("code") != "OK":
        return Unavailable("NO_DATA")
    info = np.array(fit["information"])
    w = np.linalg.eigvalsh(info)
    if np.any(np.abs(w) < 1e-12 * max(1.0, np.max(np.abs(w)))):
        return Unavailable("SINGULAR_INFORMATION")
    return Unavailable("NOT_POSITIVE_DEFINITE") if np.any(w <= 0) else np.linalg.inv(info)


def wald(fit: dict, level: float = 0.95) -> dict[str, dict]:
    """Estimate, standard error and interval of each free parameter; positive ones on the logarithmic scale."""
    cov = covariance(fit)
    if isinstance(cov, Unavailable):
        return {p: cov for p in fit.get("params", {})}
    z = float(sp.norm_ppf(0.5 + level / 2))
    f, out = family(fit["family"]), {}
    for p, positive in zip(f.params, f.positive, strict=True):
        if p not in fit["free"]:
            out[p] = Unavailable("FIXED_PARAMETER")
            continue
        se = math.sqrt(cov[fit["free"].index(p), fit["free"].index(p)])
        v = fit["params"][p]
        low, high = (v * math.exp(-z * se), v * math.exp(z * se)) if positive else (v - z * se, v + z * se)
        out[p] = {"estimate": v, "se": v * se if positive else se, "lower": low, "upper": high}
    return out


def exact_rate(events: int, exposure: float, level: float = 0.95) -> tuple[float, float]:
    """Exact interval of an exponential rate from an uncensored sample."""
    q = (1 - level) / 2
    return float(sp.chi2_ppf(q, 2 * events)) / (2 * exposure), float(sp.chi2_ppf(1 - q, 2 * events)) / (2 * exposure)


def profile(loglik: Callable[[float], float], estimate: float, level: float = 0.95, positive: bool = True) -> dict:
    """Both ends where twice the loss of log-likelihood meets the chi-square quantile; a side that never does is unbounded."""
    limit, top = float(sp.chi2_ppf(level, 1)) / 2, loglik(estimate)
    out = {"estimate": estimate}
    for side, name in ((-1, "lower"), (1, "upper")):
        step, far = 0.05, None
        for _ in range(60):
            x = estimate * math.exp(side * step) if positive else estimate + side * step * max(1.0, abs(estimate))
            if top - loglik(x) >= limit:
                far = x
                break
            step *= 1.7
            if step > 40:
                break
        if far is None:
            out[name], out[name + "_unbounded"] = (0.0 if positive and side < 0 else side * math.inf), True
            continue
        a, b = estimate, far
        for _ in range(200):
            m = math.sqrt(a * b) if positive else (a + b) / 2
            a, b = (a, m) if top - loglik(m) >= limit else (m, b)
        out[name], out[name + "_unbounded"] = (a + b) / 2, False
    return out


def profile_rate(events: int, exposure: float, level: float = 0.95) -> dict:
    """Profile-likelihood interval of an exponential rate, censored or not."""
    return profile(lambda r: events * math.log(r) - r * exposure, events / exposure, level)


def profile_normal(n: int, mean: float, sd: float, level: float = 0.95) -> dict[str, dict]:
    """Profile intervals of both normal parameters from the sums of a sample (or of its logarithms)."""
    mu = profile(lambda m: -n / 2 * math.log(sd**2 + (mean - m) ** 2), mean, level, positive=False)
    return {"mu": mu, "sigma": profile(lambda s: -n * math.log(s) - n * sd**2 / (2 * s * s), sd, level)}


def derived(fit: dict, quantity: Callable[..., float], scale: str = "log", level: float = 0.95) -> dict:
    """Delta-method interval of a function of the parameters; ``scale`` is log, logit or identity."""
    cov = covariance(fit)
    if isinstance(cov, Unavailable):
        return cov
    f = family(fit["family"])
    to = {"log": math.log, "identity": float, "logit": lambda v: math.log(v / (1 - v))}[scale]
    back = {"log": math.exp, "identity": float, "logit": lambda v: 1 / (1 + math.exp(-v))}[scale]

    def at(u):
        p = dict(fit["params"])
        for name, v in zip(fit["free"], u, strict=True):
            p[name] = math.exp(v) if f.positive[f.params.index(name)] else v
        return to(quantity(*[p[k] for k in f.params]))

    u = [math.log(fit["params"][k]) if f.positive[f.params.index(k)] else fit["params"][k] for k in fit["free"]]
    grad = []
    for i in range(len(u)):
        h = 1e-3 * max(1.0, abs(u[i]))
        v = [at([*u[:i], u[i] + s * h, *u[i + 1 :]]) for s in (2, 1, -1, -2)]
        grad.append((-v[0] + 8 * v[1] - 8 * v[2] + v[3]) / (12 * h))
    value, se = at(u), math.sqrt(max(0.0, float(np.array(grad) @ cov @ np.array(grad))))
    z = float(sp.norm_ppf(0.5 + level / 2))
    return {"estimate": back(value), "lower": back(value - z * se), "upper": back(value + z * se)}


def derived_mean(fit: dict, level: float = 0.95) -> dict:
    return derived(fit, family(fit["family"]).mean, "log" if family(fit["family"]).positive[0] or fit["family"] == "lognormal" else "identity", level)


def derived_quantile(fit: dict, q: float, level: float = 0.95) -> dict:
    f = family(fit["family"])
    return derived(fit, lambda *p: float(f.quantile(np.array([q]), *p)[0]), "log" if math.isfinite(f.low(*fit["params"].values())) else "identity", level)


def derived_survival(fit: dict, t: float, level: float = 0.95) -> dict:
    f = family(fit["family"])
    return derived(fit, lambda *p: float(f.upper(np.array([t]), *p)[0]), "logit", level)

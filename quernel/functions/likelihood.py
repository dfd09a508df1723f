"""Log-likelihood contributions of observations that may be censored and truncated.

Probabilities stay logarithms throughout, so nothing is clamped: a row whose
probability is zero contributes minus infinity.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from . import special as sp
from .families import family, log_cdf, log_sf

EXACT, RIGHT, LEFT, INTERVAL = 1, 0, 2, 3
NARROW = 0.05
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(10)


def log_window(name: str, lower, upper, *params) -> np.ndarray:
    """ln P(lower < X <= upper); an end that is NaN is open.

    The difference is taken in the smaller tail.  Where the two tails are within
    ``NARROW`` in logarithms, it would cancel, and the density is integrated instead.
    """
    f = family(name)
    lower, upper = np.broadcast_arrays(np.asarray(lower, float), np.asarray(upper, float))
    low, high = np.where(np.isnan(lower), -np.inf, lower), np.where(np.isnan(upper), np.inf, upper)
    open_low, open_high = np.isneginf(low), np.isposinf(high)
    with np.errstate(all="ignore"):
        a, b = np.where(open_low, 0.0, low), np.where(open_high, 0.0, high)
        cdf_a, sf_a = np.where(open_low, -np.inf, log_cdf(name, a, *params)), np.where(open_low, 0.0, log_sf(name, a, *params))
        cdf_b, sf_b = np.where(open_high, 0.0, log_cdf(name, b, *params)), np.where(open_high, -np.inf, log_sf(name, b, *params))
        right = sf_a < cdf_b
        big, small = np.where(right, sf_a, cdf_b), np.where(right, sf_b, cdf_a)
        out = big + sp.log1mexp(np.where(small < big, small - big, -np.inf))
        out = np.where(small == -np.inf, big, out)
        narrow = (big - small < NARROW) & (high > low) & ~open_low & ~open_high & ~np.bool_(f.discrete)
        if narrow.any():
            half, middle = (high[narrow] - low[narrow]) / 2, low[narrow] + (high[narrow] - low[narrow]) / 2
            logs = f.logpdf(middle[:, None] + half[:, None] * _NODES, *params) + np.log(_WEIGHTS)
            top = logs.max(axis=1)
            out = np.array(out)
            out[narrow] = np.log(half) + top + np.log(np.exp(logs - top[:, None]).sum(axis=1))
        return np.where(high > low, out, -np.inf)


def hazard_gain(name: str, start, stop, *params) -> np.ndarray:
    """Cumulative hazard from ``start`` to ``stop`` of an exponential or Weibull family, from their difference or ratio."""
    start, stop = np.maximum(np.asarray(start, float), 0.0), np.maximum(np.asarray(stop, float), 0.0)
    if name == "exponential":
        return params[0] * (stop - start)
    k, s = params
    with np.errstate(all="ignore"):
        return np.where(start > 0, (start / s) ** k * np.expm1(k * np.log1p((stop - start) / start)), (stop / s) ** k)


def contributions(name: str, params: Sequence[float], value, status, upper, trunc_lower, trunc_upper) -> np.ndarray:
    """Log-likelihood of each observation: density, tail, head or interval, less the log-probability of its window.

    Exponential and Weibull rows that are exact or censored from the right and
    truncated from the left alone need no difference of two large logarithms.
    """
    f = family(name)
    out = np.empty(len(value))
    direct = ~np.isnan(trunc_lower) & np.isnan(trunc_upper) & (f.name in ("exponential", "weibull"))
    with np.errstate(all="ignore"):
        for kind in (EXACT, RIGHT, LEFT, INTERVAL):
            at = status == kind
            if not at.any():
                continue
            x, lo, hi = value[at], trunc_lower[at], trunc_upper[at]
            if kind == EXACT:
                own = f.logpdf(x, *params)
            elif kind == RIGHT:
                own = log_window(f.name, x, hi, *params)
            elif kind == LEFT:
                own = log_window(f.name, lo, x, *params)
            else:
                own = log_window(f.name, x, upper[at], *params)
            windowed = ~(np.isnan(lo) & np.isnan(hi))
            if windowed.any():
                own = np.array(own)
                own[windowed] -= log_window(f.name, lo[windowed], hi[windowed], *params)
            if kind in (EXACT, RIGHT) and direct[at].any():
                use = direct[at]
                gain = hazard_gain(f.name, lo[use], x[use], *params)
                rate = f.logpdf(x[use], *params) - log_sf(f.name, x[use], *params) if kind == EXACT else 0.0
                own[use] = rate - gain
            out[at] = own
    return out

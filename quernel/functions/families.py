"""Distribution families: parameters, support, density, probability and quantile functions, moments.

Each family has numpy functions of (x, *parameters).  Where the same formula is
closed in Spark's functions, ``COLUMN`` has it as a Column expression, which
stays in generated code; all else goes through Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import special as sp

EULER = 0.5772156649015329


@dataclass(frozen=True)
class Family:
    """One family; ``positive`` says which parameters are above 0, ``low`` and ``high`` bound the support."""

    name: str
    params: tuple[str, ...]
    positive: tuple[bool, ...]
    logpdf: Callable
    cdf: Callable
    low: Callable = field(default=lambda *p: -math.inf)
    high: Callable = field(default=lambda *p: math.inf)
    sf: Callable | None = None
    ppf: Callable | None = None
    mean: Callable | None = None
    var: Callable | None = None
    skew: Callable | None = None
    kurt: Callable | None = None
    mode: Callable | None = None
    discrete: bool = False

    def upper(self, x, *p):
        return self.sf(x, *p) if self.sf else 1 - self.cdf(x, *p)

    def quantile(self, q, *p):
        q = np.asarray(q, float)
        if self.ppf:
            return self.ppf(q, *p)
        if self.discrete:
            return _whole_quantile(lambda k: self.cdf(k, *p), q, self.low(*p), self.high(*p))
        low, high = self.low(*p), self.high(*p)
        low = low if math.isfinite(low) else self._edge(float(np.min(q)), -1.0, p)
        high = high if math.isfinite(high) else self._edge(float(np.max(q)), 1.0, p)
        return sp.invert(lambda v: self.cdf(v, *p), q, low, high)

    def _edge(self, q, sign, p):
        x = sign
        while (float(self.cdf(np.array([x]), *p)[0]) < q) == (sign > 0) and abs(x) < 1e300:
            x *= 4
        return x

    def entropy(self, *p, points: int = 2001) -> float:
        """Differential (or discrete) entropy: the mean of -ln f over equal steps of probability."""
        q = (np.arange(points) + 0.5) / points
        return float(-np.mean(self.logpdf(self.quantile(q, *p), *p)))

    def sample(self, rng: np.random.Generator, size: int, *p):
        """Draws; by numpy's own samplers where those are for the same parameters, else by the quantile function."""
        own = _SAMPLERS.get(self.name)
        return own(rng, size, *p) if own else self.quantile(rng.random(size), *p)


_SAMPLERS = {
    "normal": lambda r, n, m, s: r.normal(m, s, n), "lognormal": lambda r, n, m, s: r.lognormal(m, s, n), "gamma": lambda r, n, a, s: r.gamma(a, s, n), "beta": lambda r, n, a, b: r.beta(a, b, n),
    "student_t": lambda r, n, v, m, s: m + s * r.standard_t(v, n), "chi_square": lambda r, n, v: r.chisquare(v, n), "f": lambda r, n, a, b: r.f(a, b, n), "wald": lambda r, n, m, l: r.wald(m, l, n),
    "poisson": lambda r, n, l: r.poisson(l, n), "binomial": lambda r, n, k, p: r.binomial(int(k), p, n), "negative_binomial": lambda r, n, k, p: r.negative_binomial(k, p, n), "geometric": lambda r, n, p: r.geometric(p, n), "hypergeometric": lambda r, n, N, K, d: r.hypergeometric(int(K), int(N - K), int(d), n),
}


def _whole_quantile(cdf, q, low, high):
    a = np.full(q.shape, float(low) - 1)
    b = np.full(q.shape, float(high) if math.isfinite(high) else 1.0)
    while not math.isfinite(high) and np.any(cdf(b) < q) and np.max(b) < 1e15:
        b = np.where(cdf(b) < q, b * 2 + 1, b)
    while np.any(b - a > 1):
        m = np.floor((a + b) / 2)
        under = cdf(m) < q
        a, b = np.where(under, m, a), np.where(under, b, m)
    return b


def _inside(x, low, high, value):
    with np.errstate(all="ignore"):
        return np.where((x >= low) & (x <= high), value, -np.inf)


def _q(f):
    """numpy functions with warnings off."""
    def g(x, *p):
        with np.errstate(all="ignore"):
            return f(np.asarray(x, float), *p)
    return g


_LN2PI = math.log(2 * math.pi)
_norm_lp = lambda z: -0.5 * z * z - 0.5 * _LN2PI


def _gamma_lp(x, a, s):
    return np.where(x > 0, (a - 1) * np.log(np.maximum(x, sp.TINY) / s) - x / s - math.lgamma(a) - math.log(s), -np.inf)


def _beta_lp(x, a, b):
    c = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return np.where((x > 0) & (x < 1), (a - 1) * np.log(np.maximum(x, sp.TINY)) + (b - 1) * np.log1p(-np.minimum(x, 1 - 1e-17)) + c, -np.inf)


def _f_lp(x, m, n):
    c = math.lgamma((m + n) / 2) - math.lgamma(m / 2) - math.lgamma(n / 2) + m / 2 * math.log(m / n)
    return np.where(x > 0, c + (m / 2 - 1) * np.log(np.maximum(x, sp.TINY)) - (m + n) / 2 * np.log1p(m * x / n), -np.inf)


def _wald_cdf(x, mu, lam):
    y = np.maximum(x, sp.TINY)
    r = np.sqrt(lam / y)
    return np.where(x > 0, sp.norm_cdf(r * (y / mu - 1)) + np.exp(2 * lam / mu + sp.log_norm_cdf(-r * (y / mu + 1))), 0.0)


def _tri_cdf(x, a, m, b):
    left = (x - a) ** 2 / ((b - a) * max(m - a, sp.TINY))
    right = 1 - (b - x) ** 2 / ((b - a) * max(b - m, sp.TINY))
    return np.where(x <= a, 0.0, np.where(x >= b, 1.0, np.where(x < m, left, right)))


def _tri_lp(x, a, m, b):
    left, right = 2 * (x - a) / ((b - a) * max(m - a, sp.TINY)), 2 * (b - x) / ((b - a) * max(b - m, sp.TINY))
    return np.where((x >= a) & (x <= b), np.log(np.maximum(np.where(x < m, left, right), sp.TINY)), -np.inf)


def _gev_t(x, k, m, s):
    z = (x - m) / s
    return np.exp(-z) if abs(k) < 1e-9 else np.where(1 + k * z > 0, np.maximum(1 + k * z, sp.TINY) ** (-1 / k), np.where(k > 0, np.inf, 0.0))


def _gev_lp(x, k, m, s):
    z = (x - m) / s
    if abs(k) < 1e-9:
        return -z - np.exp(-z) - math.log(s)
    y = 1 + k * z
    return np.where(y > 0, -(1 + 1 / k) * np.log(np.maximum(y, sp.TINY)) - np.maximum(y, sp.TINY) ** (-1 / k) - math.log(s), -np.inf)


def _binom_lp(x, n, p):
    ok = (x >= 0) & (x <= n) & (x == np.floor(x))
    y = np.clip(x, 0, n)
    return np.where(ok, math.lgamma(n + 1) - sp.lgamma(y + 1) - sp.lgamma(n - y + 1) + y * math.log(p) + (n - y) * math.log1p(-p), -np.inf)


def _hyper_lp(x, N, K, n):
    ok = (x >= max(0, n + K - N)) & (x <= min(n, K)) & (x == np.floor(x))
    y = np.clip(x, max(0, n + K - N), min(n, K))
    c = lambda a, b: sp.lgamma(np.asarray(a, float) + 1) - sp.lgamma(np.asarray(b, float) + 1) - sp.lgamma(np.asarray(a - b, float) + 1)
    return np.where(ok, c(K, y) + c(N - K, n - y) - c(N, n), -np.inf)


def _hyper_cdf(x, N, K, n):
    low, high = int(max(0, n + K - N)), int(min(n, K))
    mass = np.cumsum(np.exp(_hyper_lp(np.arange(low, high + 1.0), N, K, n)))
    at = np.clip(np.floor(x) - low, -1, high - low).astype(int)
    return np.where(at < 0, 0.0, np.minimum(1.0, mass[np.maximum(at, 0)]))


_pos, _two = (True,), (True, True)
zero = lambda *p: 0.0

ALL: dict[str, Family] = {f.name: f for f in (
    Family("exponential", ("rate",), _pos, _q(lambda x, r: _inside(x, 0, np.inf, math.log(r) - r * x)), _q(lambda x, r: np.where(x > 0, -np.expm1(-r * x), 0.0)), zero,
           sf=_q(lambda x, r: np.where(x > 0, np.exp(-r * x), 1.0)), ppf=_q(lambda q, r: -np.log1p(-q) / r), mean=lambda r: 1 / r, var=lambda r: 1 / r**2, skew=lambda r: 2.0, kurt=lambda r: 6.0, mode=lambda r: 0.0),
    Family("weibull", ("shape", "scale"), _two, _q(lambda x, k, s: np.where(x > 0, math.log(k / s) + (k - 1) * np.log(np.maximum(x, sp.TINY) / s) - (np.maximum(x, 0) / s) ** k, -np.inf)), _q(lambda x, k, s: -np.expm1(-((np.maximum(x, 0) / s) ** k))), zero,
           sf=_q(lambda x, k, s: np.exp(-((np.maximum(x, 0) / s) ** k))), ppf=_q(lambda q, k, s: s * (-np.log1p(-q)) ** (1 / k)), mean=lambda k, s: s * math.gamma(1 + 1 / k), var=lambda k, s: s * s * (math.gamma(1 + 2 / k) - math.gamma(1 + 1 / k) ** 2), mode=lambda k, s: s * ((k - 1) / k) ** (1 / k) if k > 1 else 0.0),
    Family("gumbel", ("location", "scale"), (False, True), _q(lambda x, m, s: -(x - m) / s - np.exp(-(x - m) / s) - math.log(s)), _q(lambda x, m, s: np.exp(-np.exp(-(x - m) / s))),
           sf=_q(lambda x, m, s: -np.expm1(-np.exp(-(x - m) / s))), ppf=_q(lambda q, m, s: m - s * np.log(-np.log(q))), mean=lambda m, s: m + EULER * s, var=lambda m, s: math.pi**2 / 6 * s * s, skew=lambda m, s: 1.1395470994046486, kurt=lambda m, s: 2.4, mode=lambda m, s: m),
    Family("normal", ("mu", "sigma"), (False, True), _q(lambda x, m, s: _norm_lp((x - m) / s) - math.log(s)), _q(lambda x, m, s: sp.norm_cdf((x - m) / s)),
           sf=_q(lambda x, m, s: sp.norm_sf((x - m) / s)), ppf=_q(lambda q, m, s: m + s * sp.norm_ppf(q)), mean=lambda m, s: m, var=lambda m, s: s * s, skew=lambda m, s: 0.0, kurt=lambda m, s: 0.0, mode=lambda m, s: m),
    Family("lognormal", ("mu", "sigma"), (False, True), _q(lambda x, m, s: np.where(x > 0, _norm_lp((np.log(np.maximum(x, sp.TINY)) - m) / s) - math.log(s) - np.log(np.maximum(x, sp.TINY)), -np.inf)), _q(lambda x, m, s: np.where(x > 0, sp.norm_cdf((np.log(np.maximum(x, sp.TINY)) - m) / s), 0.0)), zero,
           sf=_q(lambda x, m, s: np.where(x > 0, sp.norm_sf((np.log(np.maximum(x, sp.TINY)) - m) / s), 1.0)), ppf=_q(lambda q, m, s: np.exp(m + s * sp.norm_ppf(q))), mean=lambda m, s: math.exp(m + s * s / 2), var=lambda m, s: math.expm1(s * s) * math.exp(2 * m + s * s), skew=lambda m, s: (math.exp(s * s) + 2) * math.sqrt(math.expm1(s * s)), kurt=lambda m, s: math.exp(4 * s * s) + 2 * math.exp(3 * s * s) + 3 * math.exp(2 * s * s) - 6, mode=lambda m, s: math.exp(m - s * s)),
    Family("gamma", ("shape", "scale"), _two, _q(_gamma_lp), _q(lambda x, a, s: sp.gamma_pq(a, x / s)[0]), zero, sf=_q(lambda x, a, s: sp.gamma_pq(a, x / s)[1]), mean=lambda a, s: a * s, var=lambda a, s: a * s * s, skew=lambda a, s: 2 / math.sqrt(a), kurt=lambda a, s: 6 / a, mode=lambda a, s: max(a - 1, 0.0) * s),
    Family("uniform", ("low", "high"), (False, False), _q(lambda x, a, b: _inside(x, a, b, -math.log(b - a))), _q(lambda x, a, b: np.clip((x - a) / (b - a), 0, 1)), lambda a, b: a, lambda a, b: b, ppf=_q(lambda q, a, b: a + q * (b - a)), mean=lambda a, b: (a + b) / 2, var=lambda a, b: (b - a) ** 2 / 12, skew=lambda a, b: 0.0, kurt=lambda a, b: -1.2, mode=lambda a, b: (a + b) / 2),
    Family("beta", ("a", "b"), _two, _q(_beta_lp), _q(lambda x, a, b: sp.beta_i(a, b, x)), zero, lambda a, b: 1.0, mean=lambda a, b: a / (a + b), var=lambda a, b: a * b / ((a + b) ** 2 * (a + b + 1)), skew=lambda a, b: 2 * (b - a) * math.sqrt(a + b + 1) / ((a + b + 2) * math.sqrt(a * b)), mode=lambda a, b: (a - 1) / (a + b - 2) if min(a, b) > 1 else math.nan),
    Family("logistic", ("location", "scale"), (False, True), _q(lambda x, m, s: -np.abs(x - m) / s - 2 * np.log1p(np.exp(-np.abs(x - m) / s)) - math.log(s)), _q(lambda x, m, s: 1 / (1 + np.exp(-(x - m) / s))),
           sf=_q(lambda x, m, s: 1 / (1 + np.exp((x - m) / s))), ppf=_q(lambda q, m, s: m + s * (np.log(q) - np.log1p(-q))), mean=lambda m, s: m, var=lambda m, s: (math.pi * s) ** 2 / 3, skew=lambda m, s: 0.0, kurt=lambda m, s: 1.2, mode=lambda m, s: m),
    Family("pareto", ("alpha", "minimum"), _two, _q(lambda x, a, m: np.where(x >= m, math.log(a) + a * math.log(m) - (a + 1) * np.log(np.maximum(x, sp.TINY)), -np.inf)), _q(lambda x, a, m: np.where(x > m, -np.expm1(a * np.log(m / np.maximum(x, m))), 0.0)), lambda a, m: m,
           sf=_q(lambda x, a, m: np.where(x > m, (m / np.maximum(x, m)) ** a, 1.0)), ppf=_q(lambda q, a, m: m * np.exp(-np.log1p(-q) / a)), mean=lambda a, m: a * m / (a - 1) if a > 1 else math.inf, var=lambda a, m: m * m * a / ((a - 1) ** 2 * (a - 2)) if a > 2 else math.inf, mode=lambda a, m: m),
    Family("cauchy", ("location", "scale"), (False, True), _q(lambda x, m, s: -math.log(math.pi * s) - np.log1p(((x - m) / s) ** 2)), _q(lambda x, m, s: 0.5 + np.arctan((x - m) / s) / math.pi), ppf=_q(lambda q, m, s: m + s * np.tan(math.pi * (q - 0.5))), mode=lambda m, s: m),
    Family("student_t", ("df", "location", "scale"), (True, False, True), _q(lambda x, v, m, s: math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi) - math.log(s) - (v + 1) / 2 * np.log1p(((x - m) / s) ** 2 / v)), _q(lambda x, v, m, s: sp.t_cdf((x - m) / s, v)), mean=lambda v, m, s: m if v > 1 else math.nan, var=lambda v, m, s: s * s * v / (v - 2) if v > 2 else math.inf, mode=lambda v, m, s: m),
    Family("chi_square", ("df",), _pos, _q(lambda x, v: _gamma_lp(x, v / 2, 2.0)), _q(lambda x, v: sp.gamma_pq(v / 2, x / 2)[0]), zero, sf=_q(lambda x, v: sp.gamma_pq(v / 2, x / 2)[1]), mean=lambda v: v, var=lambda v: 2 * v, skew=lambda v: math.sqrt(8 / v), kurt=lambda v: 12 / v, mode=lambda v: max(v - 2, 0.0)),
    Family("f", ("df1", "df2"), _two, _q(_f_lp), _q(lambda x, m, n: sp.beta_i(m / 2, n / 2, m * np.maximum(x, 0) / (m * np.maximum(x, 0) + n))), zero, mean=lambda m, n: n / (n - 2) if n > 2 else math.inf, var=lambda m, n: 2 * n * n * (m + n - 2) / (m * (n - 2) ** 2 * (n - 4)) if n > 4 else math.inf),
    Family("laplace", ("location", "scale"), (False, True), _q(lambda x, m, s: -np.abs(x - m) / s - math.log(2 * s)), _q(lambda x, m, s: np.where(x < m, 0.5 * np.exp((x - m) / s), 1 - 0.5 * np.exp(-(x - m) / s))), ppf=_q(lambda q, m, s: m - s * np.sign(q - 0.5) * np.log1p(-2 * np.abs(q - 0.5))), mean=lambda m, s: m, var=lambda m, s: 2 * s * s, skew=lambda m, s: 0.0, kurt=lambda m, s: 3.0, mode=lambda m, s: m),
    Family("rayleigh", ("scale",), _pos, _q(lambda x, s: np.where(x > 0, np.log(np.maximum(x, sp.TINY)) - 2 * math.log(s) - x * x / (2 * s * s), -np.inf)), _q(lambda x, s: -np.expm1(-(np.maximum(x, 0) ** 2) / (2 * s * s))), zero, ppf=_q(lambda q, s: s * np.sqrt(-2 * np.log1p(-q))), mean=lambda s: s * math.sqrt(math.pi / 2), var=lambda s: (4 - math.pi) / 2 * s * s, skew=lambda s: 0.6311106578189371, kurt=lambda s: 0.24508930068764556, mode=lambda s: s),
    Family("wald", ("mu", "lambda"), _two, _q(lambda x, m, l: np.where(x > 0, 0.5 * (math.log(l) - _LN2PI - 3 * np.log(np.maximum(x, sp.TINY))) - l * (x - m) ** 2 / (2 * m * m * np.maximum(x, sp.TINY)), -np.inf)), _q(_wald_cdf), zero, mean=lambda m, l: m, var=lambda m, l: m**3 / l, skew=lambda m, l: 3 * math.sqrt(m / l), kurt=lambda m, l: 15 * m / l, mode=lambda m, l: m * (math.sqrt(1 + 9 * m * m / (4 * l * l)) - 1.5 * m / l)),
    Family("triangular", ("low", "peak", "high"), (False, False, False), _q(_tri_lp), _q(_tri_cdf), lambda a, m, b: a, lambda a, m, b: b, ppf=_q(lambda q, a, m, b: np.where(q < (m - a) / (b - a), a + np.sqrt(q * (b - a) * (m - a)), b - np.sqrt((1 - q) * (b - a) * (b - m)))), mean=lambda a, m, b: (a + m + b) / 3, var=lambda a, m, b: (a * a + m * m + b * b - a * m - a * b - m * b) / 18, kurt=lambda a, m, b: -0.6, mode=lambda a, m, b: m),
    Family("burr", ("c", "d", "scale"), (True, True, True), _q(lambda x, c, d, s: np.where(x > 0, math.log(c * d / s) + (c - 1) * np.log(np.maximum(x, sp.TINY) / s) - (d + 1) * np.log1p((np.maximum(x, 0) / s) ** c), -np.inf)), _q(lambda x, c, d, s: -np.expm1(-d * np.log1p((np.maximum(x, 0) / s) ** c))), zero, sf=_q(lambda x, c, d, s: np.exp(-d * np.log1p((np.maximum(x, 0) / s) ** c))), ppf=_q(lambda q, c, d, s: s * np.expm1(-np.log1p(-q) / d) ** (1 / c)), mean=lambda c, d, s: s * d * math.exp(math.lgamma(d - 1 / c) + math.lgamma(1 + 1 / c) - math.lgamma(d + 1)) if c * d > 1 else math.inf),
    Family("gev", ("shape", "location", "scale"), (False, False, True), _q(_gev_lp), _q(lambda x, k, m, s: np.exp(-_gev_t(x, k, m, s))), sf=_q(lambda x, k, m, s: -np.expm1(-_gev_t(x, k, m, s))), ppf=_q(lambda q, k, m, s: m - s * np.log(-np.log(q)) if abs(k) < 1e-9 else m + s * ((-np.log(q)) ** (-k) - 1) / k), mean=lambda k, m, s: m + s * EULER if abs(k) < 1e-9 else m + s * (math.gamma(1 - k) - 1) / k if k < 1 else math.inf, mode=lambda k, m, s: m if abs(k) < 1e-9 else m + s * ((1 + k) ** (-k) - 1) / k),
    Family("poisson", ("rate",), _pos, _q(lambda x, l: np.where((x >= 0) & (x == np.floor(x)), x * math.log(l) - l - sp.lgamma(np.maximum(x, 0) + 1), -np.inf)), _q(lambda x, l: np.where(x < 0, 0.0, sp.gamma_pq(np.floor(np.maximum(x, 0)) + 1, l)[1])), zero, mean=lambda l: l, var=lambda l: l, skew=lambda l: 1 / math.sqrt(l), kurt=lambda l: 1 / l, mode=lambda l: math.floor(l), discrete=True),
    Family("binomial", ("n", "p"), _two, _q(_binom_lp), _q(lambda x, n, p: np.where(x < 0, 0.0, np.where(x >= n, 1.0, sp.beta_i(n - np.clip(np.floor(x), 0, n - 1e-9), np.clip(np.floor(x), 0, n) + 1, 1 - p)))), zero, lambda n, p: n, mean=lambda n, p: n * p, var=lambda n, p: n * p * (1 - p), mode=lambda n, p: math.floor((n + 1) * p), discrete=True),
    Family("negative_binomial", ("r", "p"), _two, _q(lambda x, r, p: np.where((x >= 0) & (x == np.floor(x)), sp.lgamma(np.maximum(x, 0) + r) - sp.lgamma(np.maximum(x, 0) + 1) - math.lgamma(r) + r * math.log(p) + x * math.log1p(-p), -np.inf)), _q(lambda x, r, p: np.where(x < 0, 0.0, sp.beta_i(r, np.floor(np.maximum(x, 0)) + 1, p))), zero, mean=lambda r, p: r * (1 - p) / p, var=lambda r, p: r * (1 - p) / p**2, mode=lambda r, p: math.floor((r - 1) * (1 - p) / p) if r > 1 else 0, discrete=True),
    Family("geometric", ("p",), _pos, _q(lambda x, p: np.where((x >= 1) & (x == np.floor(x)), math.log(p) + (x - 1) * math.log1p(-p), -np.inf)), _q(lambda x, p: np.where(x < 1, 0.0, -np.expm1(np.floor(x) * math.log1p(-p)))), lambda p: 1.0, mean=lambda p: 1 / p, var=lambda p: (1 - p) / p**2, mode=lambda p: 1.0, discrete=True),
    Family("hypergeometric", ("population", "successes", "draws"), (True, True, True), _q(_hyper_lp), _q(_hyper_cdf), lambda N, K, n: max(0, n + K - N), lambda N, K, n: min(n, K), mean=lambda N, K, n: n * K / N, var=lambda N, K, n: n * K / N * (1 - K / N) * (N - n) / max(N - 1, 1), discrete=True),
)}

_log1m = _q(lambda v: sp.log1mexp(np.minimum(v, -0.0)))


def _cumulative(x, k, s):
    """Cumulative hazard of a Weibull."""
    return (np.maximum(x, 0) / s) ** k


#: name -> (ln cdf, ln sf) of (x, *parameters), each right in its own far tail.
LOGS: dict[str, tuple[Callable, Callable]] = {
    "exponential": (_q(lambda x, r: _log1m(-r * np.maximum(x, 0))), _q(lambda x, r: -r * np.maximum(x, 0))),
    "weibull": (_q(lambda x, k, s: _log1m(-_cumulative(x, k, s))), _q(lambda x, k, s: -_cumulative(x, k, s))),
    "gumbel": (_q(lambda x, m, s: -np.exp(-(x - m) / s)), _q(lambda x, m, s: _log1m(-np.exp(-(x - m) / s)))),
    "normal": (_q(lambda x, m, s: sp.log_norm_cdf((x - m) / s)), _q(lambda x, m, s: sp.log_norm_cdf(-(x - m) / s))),
    "lognormal": (_q(lambda x, m, s: np.where(x > 0, sp.log_norm_cdf((np.log(x) - m) / s), -np.inf)), _q(lambda x, m, s: np.where(x > 0, sp.log_norm_cdf(-(np.log(x) - m) / s), 0.0))),
    "gamma": (_q(lambda x, a, s: sp.log_gamma_pq(a, x / s)[0]), _q(lambda x, a, s: sp.log_gamma_pq(a, x / s)[1])),
    "chi_square": (_q(lambda x, v: sp.log_gamma_pq(v / 2, x / 2)[0]), _q(lambda x, v: sp.log_gamma_pq(v / 2, x / 2)[1])),
    "logistic": (_q(lambda x, m, s: -np.logaddexp(0, -(x - m) / s)), _q(lambda x, m, s: -np.logaddexp(0, (x - m) / s))),
    "rayleigh": (_q(lambda x, s: _log1m(-_cumulative(x, 2.0, s * math.sqrt(2)))), _q(lambda x, s: -_cumulative(x, 2.0, s * math.sqrt(2)))),
    "pareto": (_q(lambda x, a, m: _log1m(a * np.log(m / np.maximum(x, m)))), _q(lambda x, a, m: a * np.log(m / np.maximum(x, m)))),
    "burr": (_q(lambda x, c, d, s: _log1m(-d * np.log1p(_cumulative(x, c, s)))), _q(lambda x, c, d, s: -d * np.log1p(_cumulative(x, c, s)))),
    "gev": (_q(lambda x, k, m, s: -_gev_t(x, k, m, s)), _q(lambda x, k, m, s: _log1m(-_gev_t(x, k, m, s)))),
}


def log_cdf(name: str, x, *params) -> np.ndarray:
    """ln of the distribution function."""
    f = family(name)
    if f.name in LOGS:
        return LOGS[f.name][0](x, *params)
    with np.errstate(all="ignore"):
        low, high = f.cdf(x, *params), f.upper(x, *params)
        return np.where(low > 0.5, np.log1p(-high), np.log(low))


def log_sf(name: str, x, *params) -> np.ndarray:
    """ln of the survival function."""
    f = family(name)
    if f.name in LOGS:
        return LOGS[f.name][1](x, *params)
    with np.errstate(all="ignore"):
        low, high = f.cdf(x, *params), f.upper(x, *params)
        return np.where(high > 0.5, np.log1p(-low), np.log(high))


ALIASES = {"gaussian": "normal", "weibull_min": "weibull", "gumbel_right": "gumbel", "nbinom": "negative_binomial", "expon": "exponential", "studentt": "student_t", "inverse_gaussian": "wald"}


def family(name: str) -> Family:
    """A family by name or alias, whatever its case, spaces, dashes or underscores."""
    plain = lambda s: s.lower().replace(" ", "").replace("-", "").replace("_", "")
    for key, f in [*ALL.items(), *((a, ALL[k]) for a, k in ALIASES.items())]:
        if plain(key) == plain(name):
            return f
    raise ValueError(f"no family is named {name!r}")


def register(f: Family) -> None:
    """Add a family of one's own."""
    ALL[f.name] = f


def _c(x):
    return x if isinstance(x, Column) else F.lit(float(x))


def _tern(cond, a, b):
    return F.when(cond, a).otherwise(b)


#: (family, operation) -> Column of (x, *parameters).
COLUMN: dict[tuple[str, str], Callable] = {
    ("exponential", "logpdf"): lambda x, r: _tern(x >= 0, F.log(r) - r * x, F.lit(-math.inf)),
    ("exponential", "cdf"): lambda x, r: _tern(x > 0, -F.expm1(-r * x), F.lit(0.0)),
    ("exponential", "sf"): lambda x, r: _tern(x > 0, F.exp(-r * x), F.lit(1.0)),
    ("exponential", "ppf"): lambda q, r: -F.log1p(-q) / r,
    ("exponential", "logsf"): lambda x, r: -r * F.greatest(F.lit(0.0), x),
    ("weibull", "logsf"): lambda x, k, s: -F.pow(F.greatest(F.lit(0.0), x) / s, k),
    ("gumbel", "logcdf"): lambda x, m, s: -F.exp(-(x - m) / s),
    ("weibull", "logpdf"): lambda x, k, s: _tern(x > 0, F.log(k / s) + (k - 1) * F.log(x / s) - F.pow(x / s, k), F.lit(-math.inf)),
    ("weibull", "cdf"): lambda x, k, s: _tern(x > 0, -F.expm1(-F.pow(x / s, k)), F.lit(0.0)),
    ("weibull", "sf"): lambda x, k, s: _tern(x > 0, F.exp(-F.pow(x / s, k)), F.lit(1.0)),
    ("weibull", "ppf"): lambda q, k, s: s * F.pow(-F.log1p(-q), 1 / k),
    ("gumbel", "logpdf"): lambda x, m, s: -(x - m) / s - F.exp(-(x - m) / s) - F.log(s),
    ("gumbel", "cdf"): lambda x, m, s: F.exp(-F.exp(-(x - m) / s)),
    ("gumbel", "sf"): lambda x, m, s: -F.expm1(-F.exp(-(x - m) / s)),
    ("gumbel", "ppf"): lambda q, m, s: m - s * F.log(-F.log(q)),
    ("normal", "logpdf"): lambda x, m, s: -F.pow((x - m) / s, F.lit(2.0)) / 2 - F.log(s) - F.lit(_LN2PI / 2),
    ("lognormal", "logpdf"): lambda x, m, s: _tern(x > 0, -F.pow((F.log(x) - m) / s, F.lit(2.0)) / 2 - F.log(s) - F.lit(_LN2PI / 2) - F.log(x), F.lit(-math.inf)),
    ("uniform", "logpdf"): lambda x, a, b: _tern((x >= a) & (x <= b), -F.log(b - a), F.lit(-math.inf)),
    ("uniform", "cdf"): lambda x, a, b: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - a) / (b - a))),
    ("uniform", "ppf"): lambda q, a, b: a + q * (b - a),
    ("logistic", "logpdf"): lambda x, m, s: -F.abs(x - m) / s - 2 * F.log1p(F.exp(-F.abs(x - m) / s)) - F.log(s),
    ("logistic", "cdf"): lambda x, m, s: 1 / (1 + F.exp(-(x - m) / s)),
    ("logistic", "sf"): lambda x, m, s: 1 / (1 + F.exp((x - m) / s)),
    ("logistic", "ppf"): lambda q, m, s: m + s * (F.log(q) - F.log1p(-q)),
    ("pareto", "logpdf"): lambda x, a, m: _tern(x >= m, F.log(a) + a * F.log(m) - (a + 1) * F.log(x), F.lit(-math.inf)),
    ("pareto", "cdf"): lambda x, a, m: _tern(x > m, 1 - F.pow(m / x, a), F.lit(0.0)),
    ("pareto", "sf"): lambda x, a, m: _tern(x > m, F.pow(m / x, a), F.lit(1.0)),
    ("pareto", "ppf"): lambda q, a, m: m * F.exp(-F.log1p(-q) / a),
    ("cauchy", "logpdf"): lambda x, m, s: -F.log(s * F.lit(math.pi)) - F.log1p(F.pow((x - m) / s, F.lit(2.0))),
    ("cauchy", "cdf"): lambda x, m, s: 0.5 + F.atan((x - m) / s) / F.lit(math.pi),
    ("cauchy", "ppf"): lambda q, m, s: m + s * F.tan(F.lit(math.pi) * (q - 0.5)),
    ("laplace", "logpdf"): lambda x, m, s: -F.abs(x - m) / s - F.log(2 * s),
    ("laplace", "cdf"): lambda x, m, s: _tern(x < m, 0.5 * F.exp((x - m) / s), 1 - 0.5 * F.exp(-(x - m) / s)),
    ("laplace", "ppf"): lambda q, m, s: m - s * F.signum(q - 0.5) * F.log1p(-2 * F.abs(q - 0.5)),
    ("rayleigh", "logpdf"): lambda x, s: _tern(x > 0, F.log(x) - 2 * F.log(s) - x * x / (2 * s * s), F.lit(-math.inf)),
    ("rayleigh", "cdf"): lambda x, s: _tern(x > 0, -F.expm1(-x * x / (2 * s * s)), F.lit(0.0)),
    ("rayleigh", "ppf"): lambda q, s: s * F.sqrt(-2 * F.log1p(-q)),
    ("triangular", "cdf"): lambda x, a, m, b: F.when(x <= a, 0.0).when(x >= b, 1.0).when(x < m, (x - a) * (x - a) / ((b - a) * (m - a))).otherwise(1 - (b - x) * (b - x) / ((b - a) * (b - m))),
    ("burr", "logpdf"): lambda x, c, d, s: _tern(x > 0, F.log(c * d / s) + (c - 1) * F.log(x / s) - (d + 1) * F.log1p(F.pow(x / s, c)), F.lit(-math.inf)),
    ("burr", "cdf"): lambda x, c, d, s: _tern(x > 0, -F.expm1(-d * F.log1p(F.pow(x / s, c))), F.lit(0.0)),
    ("burr", "ppf"): lambda q, c, d, s: s * F.pow(F.expm1(-F.log1p(-q) / d), 1 / c),
    ("gev", "cdf"): lambda x, k, m, s: _tern(1 + k * (x - m) / s > 0, F.exp(-F.pow(F.greatest(F.lit(0.0), 1 + k * (x - m) / s), -1 / k)), _tern(k > 0, F.lit(0.0), F.lit(1.0))),
    ("geometric", "logpdf"): lambda x, p: _tern((x >= 1) & (x == F.floor(x)), F.log(p) + (x - 1) * F.log1p(-p), F.lit(-math.inf)),
    ("geometric", "cdf"): lambda x, p: _tern(x < 1, F.lit(0.0), -F.expm1(F.floor(x) * F.log1p(-p))),
}


def column(name: str, operation: str, x: str | Column, *params) -> Column:
    """``logpdf``, ``pdf``, ``cdf``, ``sf``, ``logcdf``, ``logsf``, ``ppf`` or ``isf`` of a column, and ``pmf`` and ``logpmf`` of discrete families.

    Parameters are numbers or, in closed families, columns.
    """
    f = family(name)
    x = F.col(x) if isinstance(x, str) else x
    operation = {"pmf": "pdf", "logpmf": "logpdf"}.get(operation, operation)
    if operation == "isf":
        if f.name == "exponential":
            return -F.log(x.cast("double")) / _c(params[0])
        return column(name, "ppf", 1 - x.cast("double"), *params)
    if operation == "pdf":
        return F.exp(column(name, "logpdf", x, *params))
    own = COLUMN.get((f.name, operation))
    if own:
        return own(x.cast("double"), *map(_c, params))
    if operation == "sf" and (f.name, "cdf") in COLUMN:
        return 1 - COLUMN[f.name, "cdf"](x.cast("double"), *map(_c, params))
    call = {"logpdf": f.logpdf, "cdf": f.cdf, "sf": f.upper, "ppf": f.quantile, "logcdf": partial(log_cdf, f.name), "logsf": partial(log_sf, f.name)}[operation]
    values = tuple(float(p) for p in params)

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        v = v.to_numpy(float)
        if operation == "ppf" and not f.ppf:  # a search for each number, so equal ones share it
            v, place = np.unique(v, return_inverse=True)
            return pd.Series(np.asarray(call(v, *values), float)[place])
        return pd.Series(np.asarray(call(v, *values), float))

    return run(x.cast("double"))

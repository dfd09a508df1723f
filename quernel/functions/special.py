"""Special functions on numpy arrays: error function, gamma and beta families, their inverses."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.frompyfunc(math.lgamma, 1, 1)
TINY = 1e-300
#: Factors of a continued fraction stay a rounding or two from 1 at its end; asking for less goes on to the last step.
CLOSE = 5e-16


#: Rational approximations of the error function by range (Cody 1969): below 0.46875, up to 4, and beyond; numerators and denominators from the highest power.
ERF_LOW = ((1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3))
ERFC_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
ERFC_FAR = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def ratio(pair, x):
    """A rational function of numbers or Columns by Horner's rule."""
    out = []
    for c in pair:
        v = c[0]
        for k in c[1:]:
            v = v * x + k
        out.append(v)
    return out[0] / out[1]


def erfc(x):
    x = np.asarray(x, float)
    flat = np.atleast_1d(x).ravel()
    y = np.abs(flat)
    out = np.where(np.isnan(y), np.nan, 0.0)  # 0 beyond 27, where the tail is less than any number
    low, far = y <= 0.46875, (y > 4) & (y < 27.5)
    middle = ~low & (y <= 4)
    out[low] = 1 - flat[low] * ratio(ERF_LOW, flat[low] ** 2)
    for part, scaled in ((middle, lambda v: ratio(ERFC_MIDDLE, v)), (far, lambda v: (1 / math.sqrt(math.pi) - ratio(ERFC_FAR, 1 / (v * v)) / (v * v)) / v)):
        v = y[part]
        cut = np.trunc(v * 16) / 16  # e^(-v^2) in two factors, so that its relative error stays small
        out[part] = np.exp(-cut * cut) * np.exp(-(v - cut) * (v + cut)) * scaled(v)
    out = np.where((flat < 0) & ~low, 2 - out, out)
    return out.reshape(x.shape)


def lgamma(x):
    return np.asarray(_lgamma(np.asarray(x, float)), float)


def norm_cdf(z):
    return 0.5 * erfc(-np.asarray(z, float) / math.sqrt(2))


def norm_sf(z):
    return 0.5 * erfc(np.asarray(z, float) / math.sqrt(2))


def log_norm_cdf(z):
    """ln of the normal distribution function: by the upper tail for z > 0, by an asymptotic series far in the lower tail."""
    z = np.asarray(z, float)
    with np.errstate(all="ignore"):
        out = np.where(z > 0, np.log1p(-norm_sf(np.maximum(z, 0.0))), np.log(norm_cdf(np.minimum(z, 0.0))))
        far = z < -35
        if np.any(far):
            y = np.where(far, z, -40.0)
            r = 1 / (y * y)
            series = np.log1p(-r * (1 - 3 * r * (1 - 5 * r * (1 - 7 * r))))
            out = np.where(far, -0.5 * y * y - np.log(-y) - 0.5 * math.log(2 * math.pi) + series, out)
    return out


def inverse_mills(z):
    """Normal density over the upper tail; close to z + 1 / z far out."""
    z = np.asarray(z, float)
    return np.exp(-0.5 * z * z - 0.5 * math.log(2 * math.pi) - log_norm_cdf(-z))


#: Rational approximations of normal quantiles (Wichura 1988): middle, tails, far tails.
_PPF = (
    (
        (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0),
        (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
    ),
    (
        (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
        (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0),
    ),
    (
        (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0),
        (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
    ),
)


def norm_ppf(q):
    q = np.asarray(q, float)
    flat = np.atleast_1d(q).ravel()
    away = flat - 0.5
    out = np.full(flat.shape, np.nan)
    middle = np.abs(away) <= 0.425
    out[middle] = away[middle] * ratio(_PPF[0], 0.180625 - away[middle] ** 2)
    tail = ~middle & (flat > 0) & (flat < 1)
    r = np.sqrt(-np.log(np.where(away[tail] < 0, flat[tail], 1 - flat[tail])))
    out[tail] = np.sign(away[tail]) * np.where(r <= 5, ratio(_PPF[1], r - 1.6), ratio(_PPF[2], r - 5))
    out[flat <= 0], out[flat >= 1] = -np.inf, np.inf
    return out.reshape(q.shape)


def digamma(x):
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    for _ in range(12):
        small = x < 12
        out = np.where(small, out - 1 / x, out)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x):
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    for _ in range(12):
        small = x < 12
        out = np.where(small, out + 1 / (x * x), out)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def log1pmx(d):
    """ln(1 + d) - d without cancellation for small d."""
    d = np.asarray(d, float)
    with np.errstate(all="ignore"):
        r = d / (2 + d)  # ln(1 + d) = 2 artanh r
        square, total = r * r, np.zeros_like(d)
        for k in range(27, 1, -2):
            total = square * (total + 1 / k)
        return np.where(np.abs(d) < 0.3, 2 * r * total - r * d, np.log1p(d) - d)


def stirling_error(a):
    """ln gamma(a) less Stirling's (a - 1/2) ln a - a + ln(2 pi) / 2."""
    a = np.asarray(a, float)
    y = np.maximum(a, 10.0)
    q = 1 / (y * y)
    series = (1 / 12 - q * (1 / 360 - q * (1 / 1260 - q * (1 / 1680 - q / 1188)))) / y
    small = np.minimum(a, 10.0)
    return np.where(a >= 10, series, lgamma(small) - (small - 0.5) * np.log(small) + small - 0.5 * math.log(2 * math.pi))


def log_ratio(x, scale):
    """ln(x / scale), also where the quotient leaves the range of doubles."""
    with np.errstate(all="ignore"):
        q = np.asarray(x, float) / scale
        return np.where((q > 1e-290) & (q < 1e290), np.log(q), np.log(x) - np.log(scale))


def log_gamma_front(a, x):
    """ln of x^a e^-x / gamma(a)."""
    with np.errstate(all="ignore"):
        large = a * log1pmx((x - a) / a) + 0.5 * np.log(a / (2 * math.pi)) - stirling_error(a)
        return np.where(a >= 10, large, a * np.log(x) - x - lgamma(a))


def log_gamma_pq(a, x):
    """ln of the regularised lower and upper incomplete gamma functions, each right in its own far tail."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    inner = (x > 0) & np.isfinite(x)
    y = np.where(inner, x, 1.0)
    with np.errstate(all="ignore"):
        front = log_gamma_front(a, y)
        series = y < a + 1
        total, term = np.zeros_like(y), 1 / a
        v = np.where(series, y, 0.0)
        for n in range(1, 100_000):
            total = total + term
            term = term * v / (a + n)
            if np.all(term <= 1e-17 * total):
                break
        v = np.where(series, a + 2, y)
        b = v + 1 - a
        c, d = np.full_like(v, 1 / TINY), 1 / b
        h = d
        for n in range(1, 100_000):
            k = -n * (n - a)
            b = b + 2
            d = 1 / np.where(np.abs(k * d + b) < TINY, TINY, k * d + b)
            c = np.where(np.abs(b + k / c) < TINY, TINY, b + k / c)
            h = h * d * c
            if np.all(np.abs(d * c - 1) < 3e-16):
                break
        own = np.where(series, front + np.log(total), front + np.log(h))
        other = log1mexp(np.minimum(own, -1e-300))
    lower, upper = np.where(series, own, other), np.where(series, other, own)
    return np.where(x <= 0, -np.inf, np.where(np.isposinf(x), 0.0, lower)), np.where(x <= 0, 0.0, np.where(np.isposinf(x), -np.inf, upper))


def log_gamma_q_slopes(a: float, x):
    """ln Q(a, x) for one shape, and its first and second derivatives by the shape.

    Below a + 1 from the series of P, whose terms y^k / gamma(a + k + 1) are differentiated one by one; above it from
    the continued fraction of Q, run backwards on values with two derivatives.
    """
    x = np.asarray(x, float)
    out = np.zeros((3, *x.shape))
    low, high = (x > 0) & (x < a + 1), (x >= a + 1) & np.isfinite(x)
    if low.any():
        y = x[low]
        ly, psi, tri = np.log(y), float(digamma(a + 1)), float(trigamma(a + 1))
        term, sums = np.ones_like(y), np.zeros((3, len(y)))
        for k in range(100_000):
            for row, share in enumerate((1.0, -psi, psi * psi - tri)):
                sums[row] += term * share
            if np.all(term * (1 + psi * psi) <= 1e-17 * sums[0]) and k > 2:
                break
            n = a + k + 1
            term = term * y / n
            psi, tri = psi + 1 / n, tri - 1 / (n * n)
        t0, t1, t2 = sums
        scale = np.exp(a * ly - y - math.lgamma(a + 1))
        p0, p1, p2 = scale * t0, scale * (t0 * ly + t1), scale * (t0 * ly * ly + 2 * t1 * ly + t2)
        q = 1 - p0
        out[0][low], out[1][low] = np.log1p(-p0), -p1 / q
        out[2][low] = -p2 / q - (p1 / q) ** 2
    if high.any():
        y = x[high]
        k0, k1, k2 = y + 1 - a, np.full(len(y), -1.0), np.zeros(len(y))
        near = float(np.min(y - a))
        depth = int(min(20_000, 60 + 40 * math.sqrt(a) * min(1.0, 4 * math.sqrt(a) / max(near, 1.0)) + 400 / max(near, 1.0)))
        k0 = y + 1 - a + 2 * depth
        for i in range(depth, 0, -1):
            n0, n1 = -i * (i - a), float(i)
            q0 = n0 / k0
            q1 = (n1 - q0 * k1) / k0
            q2 = -(2 * q1 * k1 + q0 * k2) / k0
            k0, k1, k2 = y + 1 - a + 2 * (i - 1) + q0, -1 + q1, q2
        # Q is the front times 1 / k0.
        out[0][high] = log_gamma_front(a, y) - np.log(k0)
        out[1][high] = np.log(y) - float(digamma(a)) - k1 / k0
        out[2][high] = -float(trigamma(a)) - (k2 / k0 - (k1 / k0) ** 2)
    out[0][np.isposinf(x)] = -np.inf
    return out


def gamma_pq(a, x):
    """Regularised lower and upper incomplete gamma functions: a power series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    xs = np.maximum(x, 0.0)
    p, q = np.zeros(xs.shape), np.zeros(xs.shape)
    series = xs < a + 1
    with np.errstate(all="ignore"):
        front = np.exp(log_gamma_front(a, np.maximum(xs, TINY)))
        if np.any(series):
            k, y = a[series], xs[series]
            term = 1 / k
            total = term.copy()
            for n in range(1, 2000):
                term = term * y / (k + n)
                total = total + term
                if np.all(np.abs(term) <= 1e-17 * np.abs(total)):
                    break
            p[series] = front[series] * total
        if not np.all(series):
            k, y = a[~series], xs[~series]
            b = y + 1 - k
            c, d = np.full_like(y, 1 / TINY), 1 / b
            h = d
            for n in range(1, 2000):
                f = -n * (n - k)
                b = b + 2
                d = 1 / np.where(np.abs(f * d + b) < TINY, TINY, f * d + b)
                c = np.where(np.abs(b + f / c) < TINY, TINY, b + f / c)
                h = h * d * c
                if np.all(np.abs(d * c - 1) < CLOSE):
                    break
            q[~series] = front[~series] * h
    lower = np.where(series, p, 1 - q)
    upper = np.where(series, 1 - p, q)
    zero, top = x <= 0, np.isposinf(x)
    return np.where(zero, 0.0, np.where(top, 1.0, np.clip(lower, 0, 1))), np.where(zero, 1.0, np.where(top, 0.0, np.clip(upper, 0, 1)))


def beta_i(a, b, x):
    """Regularised incomplete beta function by its continued fraction, on the side where that converges."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0, 1)
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(np.maximum(y, TINY)) + q * np.log1p(-np.minimum(y, 1 - 1e-17))) / p
        safe = lambda v: np.where(np.abs(v) < TINY, TINY, v)
        c = np.ones_like(y)
        d = 1 / safe(1 - (p + q) * y / (p + 1))
        h = d
        for m in range(1, 1000):
            k = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            d, c = 1 / safe(1 + k * d), safe(1 + k / c)
            h = h * d * c
            k = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            d, c = 1 / safe(1 + k * d), safe(1 + k / c)
            h = h * d * c
            if np.all(np.abs(d * c - 1) < CLOSE):
                break
    out = np.clip(np.where(swap, 1 - front * h, front * h), 0, 1)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def log1mexp(v):
    """ln(1 - e^v) for v < 0."""
    v = np.asarray(v, float)
    with np.errstate(all="ignore"):
        return np.where(v > -math.log(2), np.log(-np.expm1(v)), np.log1p(-np.exp(v)))


def invert(cdf, q, low, high, steps: int = 200):
    """Quantiles by bisection of a distribution function between finite bounds."""
    q = np.asarray(q, float)
    a, b = np.full(q.shape, float(low)), np.full(q.shape, float(high))
    for _ in range(steps):
        m = 0.5 * (a + b)
        under = cdf(m) < q
        a, b = np.where(under, m, a), np.where(under, b, m)
        if np.all((b - a) <= 1e-14 * np.maximum(np.abs(b), 1e-300)):
            break
    return 0.5 * (a + b)


def chi2_sf(x, df):
    return gamma_pq(np.asarray(df, float) / 2, np.asarray(x, float) / 2)[1]


def chi2_ppf(q, df):
    top = float(np.max(df) + 40 * math.sqrt(2 * float(np.max(df))) + 80)
    return invert(lambda v: gamma_pq(np.asarray(df, float) / 2, v / 2)[0], np.asarray(q, float), 0.0, top)


def t_cdf(x, df):
    x = np.asarray(x, float)
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + x * x))
    return np.where(x > 0, 1 - tail, tail)


def t_ppf(q, df):
    return invert(lambda v: t_cdf(v, df), np.asarray(q, float), -1e6, 1e6)


def kolmogorov_exact(d: float, n: int) -> float:
    """Probability that the two-sided distance of n uniform values is at least ``d``, by powers of a banded matrix."""
    if d <= 0:
        return 1.0
    if d >= 1:
        return 0.0
    k = int(math.floor(n * d)) + 1
    m, h = 2 * k - 1, k - n * d
    matrix = np.tril(np.ones((m, m)), 1)
    powers = h ** np.arange(1, m + 1)
    matrix[:, 0] -= powers
    matrix[-1, :] -= powers[::-1]
    matrix[-1, 0] += max(2 * h - 1, 0.0) ** m
    i, j = np.indices((m, m))
    matrix /= np.array([math.factorial(v) if v <= 170 else math.inf for v in range(m + 1)], float)[np.maximum(i - j + 1, 0)]
    out, base, power, scale, own = np.eye(m), matrix, n, 0, 0
    while power:
        if power & 1:
            out, scale = out @ base, scale + own
            e = math.frexp(float(np.max(np.abs(out))))[1]
            out, scale = np.ldexp(out, -e), scale + e
        base, own = base @ base, 2 * own
        e = math.frexp(float(np.max(np.abs(base))))[1]
        base, own, power = np.ldexp(base, -e), own + e, power >> 1
    value = float(out[k - 1, k - 1])
    return 1 - math.exp(math.log(value) + scale * math.log(2) + math.lgamma(n + 1) - n * math.log(n)) if value > 0 else 1.0


def kolmogorov_one_sided(d: float, n: int) -> float:
    """Probability that one side's distance of n uniform values is at least ``d``: the finite sum of its polynomial terms."""
    if d <= 0 or d >= 1:
        return float(d <= 0)
    j = np.arange(int(math.floor(n * (1 - d))) + 1, dtype=float)
    with np.errstate(all="ignore"):
        logs = math.lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + (n - j) * np.log(np.maximum(1 - d - j / n, 0.0)) + (j - 1) * np.log(d + j / n)
    return float(min(1.0, d * np.exp(logs[np.isfinite(logs)]).sum()))


def kolmogorov_sf(x):
    """Upper tail of the limiting Kolmogorov distribution."""
    x = float(x)
    if x <= 0:
        return 1.0
    if x < 1.18:
        t = math.exp(-math.pi**2 / (8 * x * x))
        return 1 - math.sqrt(2 * math.pi) / x * (t + t**9 + t**25 + t**49)
    t = math.exp(-2 * x * x)
    return min(1.0, 2 * (t - t**4 + t**9 - t**16))

"""Newton fits on exact derivatives, profile intervals, Student's t, L-moments and triangles against plain calculations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from quernel.functions import special as sp
from quernel.functions.families import family
from quernel.functions.likelihood import contributions
from quernel.operators import profile, scale, score, shapes, uncertainty
from quernel.operators.fit import fit_weibull, newton_fit
from quernel.sources.observations import observations

TRUE = {"exponential": (0.5,), "weibull": (1.6, 3.0), "gumbel": (2.0, 1.5), "normal": (1.0, 2.0), "lognormal": (0.3, 0.8), "gamma": (2.3, 1.7)}


def sample(name, n=400, seed=1, censored=True):
    r = np.random.default_rng(seed)
    x = np.asarray(family(name).quantile(r.random(n), *TRUE[name]), float)
    c = np.asarray(family(name).quantile(0.2 + 0.8 * r.random(n), *TRUE[name]), float)
    seen = (x <= c) | (not censored)
    return np.where(seen, x, c), seen


def loglik(name, p, x, seen):
    none = np.full(len(x), np.nan)
    return float(np.sum(contributions(name, p, x, seen.astype(float), none, none, none)))


def rows(spark, x, seen):
    return observations(spark.createDataFrame([(float(a), bool(b)) for a, b in zip(x, seen)], "x double, seen boolean"), "x", event="seen")


def test_slopes_of_incomplete_gamma():
    for a in (0.05, 0.7, 3.0, 60.0, 2000.0):
        x = a * np.array([0.01, 0.5, 0.99, 1.0, 1.01, 1.5, 4.0, 9.0]) + np.array([0, 0, 0, 1, 1.01, 0, 2, 5])
        lq, d1, d2 = sp.log_gamma_q_slopes(a, x)
        f, g, h = (lambda t: sp.log_gamma_pq(t, x)[1]), (lambda t: sp.log_gamma_q_slopes(t, x)[1]), 1e-4 * a
        assert np.allclose(lq, f(a), rtol=1e-10) and np.allclose(d1, (-f(a + 2 * h) + 8 * f(a + h) - 8 * f(a - h) + f(a - 2 * h)) / (12 * h), rtol=1e-7)
        assert np.allclose(d2, (-g(a + 2 * h) + 8 * g(a + h) - 8 * g(a - h) + g(a - 2 * h)) / (12 * h), rtol=1e-7)
    assert list(sp.log_gamma_q_slopes(2.0, np.array([0.0, np.inf]))[0]) == [0.0, -np.inf]


@pytest.mark.parametrize("name", sorted(TRUE))
def test_derivatives_of_censored_samples(spark, name):
    x, seen = sample(name, 60)
    p = np.array([v * 1.1 for v in TRUE[name]])
    positive = np.array(family(name).positive)
    u = np.where(positive, np.log(np.where(positive, p, 1)), p)
    at = lambda v: loglik(name, np.where(positive, np.exp(v), v), x, seen)
    (value, g, hess), (again, *_) = score.derivatives_at(rows(spark, x, seen), name, [p, p])
    assert value == pytest.approx(at(u), rel=1e-9) and again == value
    h, e = 1e-3, np.eye(len(u))
    for i in range(len(u)):
        slope = (-at(u + 2 * h * e[i]) + 8 * at(u + h * e[i]) - 8 * at(u - h * e[i]) + at(u - 2 * h * e[i])) / (12 * h)
        assert g[i] == pytest.approx(slope, rel=1e-6, abs=1e-6)
        for j in range(len(u)):
            bend = (at(u + h * e[i] + h * e[j]) - at(u + h * e[i] - h * e[j]) - at(u - h * e[i] + h * e[j]) + at(u - h * e[i] - h * e[j])) / (4 * h * h)
            assert hess[i, j] == pytest.approx(bend, rel=1e-4, abs=1e-3)


@pytest.mark.parametrize("name", sorted(TRUE))
def test_newton_finds_the_top(spark, name):
    x, seen = sample(name)
    r = newton_fit(rows(spark, x, seen), name)
    p = [r["params"][k] for k in family(name).params]
    assert r["code"] == "OK" and r["passes"] <= 12 and r["loglik"] == pytest.approx(loglik(name, p, x, seen), rel=1e-9)
    for i in range(len(p)):
        for step in (-1e-3, 1e-3):
            assert loglik(name, [v + step * (k == i) for k, v in enumerate(p)], x, seen) < r["loglik"]


def test_newton_codes(spark):
    code = lambda name, x, seen: newton_fit(rows(spark, np.array(x, float), np.array(seen)), name)["code"]
    assert code("weibull", [1, 2, 3], [False] * 3) == "NO_OBSERVED_EVENTS"
    assert code("weibull", [0, 2, 3], [True] * 3) == "INVALID_SUPPORT" and code("exponential", [-1, 2], [True, True]) == "INVALID_SUPPORT"
    assert code("normal", [2, 2, 2], [True] * 3) == "UNBOUNDED_LIKELIHOOD" and code("gamma", [2, 2, 1], [True, True, False]) == "UNBOUNDED_LIKELIHOOD"
    assert code("weibull", [2, 1, 0], [True, True, False]) == "OK" and code("exponential", [0, 2], [True, True]) == "OK"
    held = newton_fit(rows(spark, *sample("weibull")), "weibull", fixed={0: 2.0})
    assert held["params"]["shape"] == 2.0 and held["free"] == ["scale"]


def brute_interval(name, psi, x, seen, p, level=0.95):
    """Ends of the quantity on the contour, by directions from the estimate."""
    positive = np.array(family(name).positive)
    top = np.where(positive, np.log(np.where(positive, p, 1)), p)
    natural = lambda u: np.where(positive, np.exp(u), u)
    goal = loglik(name, p, x, seen) - float(sp.chi2_ppf(level, 1)) / 2

    def reach(t):
        d = np.array([math.cos(t), math.sin(t)])
        a, b = 0.0, 1e-3
        while loglik(name, natural(top + b * d), x, seen) > goal:
            b *= 2
        for _ in range(34):
            m = (a + b) / 2
            a, b = (m, b) if loglik(name, natural(top + m * d), x, seen) > goal else (a, m)
        return psi(*natural(top + a * d))

    ends = []
    for sign in (1, -1):
        grid = np.linspace(0, 2 * math.pi, 13)
        best = max(grid, key=lambda t: sign * reach(t))
        width = grid[1]
        for _ in range(8):
            grid = np.linspace(best - width, best + width, 5)
            best, width = max(grid, key=lambda t: sign * reach(t)), width / 2
        ends.append(reach(best))
    return min(ends), max(ends)


@pytest.mark.parametrize("name", ["weibull", "gamma", "lognormal", "normal", "gumbel"])
def test_profile_intervals(spark, name):
    x, seen = sample(name, 40)
    obs = rows(spark, x, seen)
    fitted = newton_fit(obs, name)
    f = family(name)
    p = [fitted["params"][k] for k in f.params]
    more = [("mean",), ("quantile", 0.9), ("survival", float(np.median(x)))]
    asked = [(k,) for k in f.params] + more if name in ("weibull", "gumbel") else [(f.params[0],), more[1]]
    got = profile.intervals(obs, fitted, asked)
    plain = {"mean": lambda q: f.mean, "quantile": lambda q: lambda *v: float(f.quantile(np.array([q]), *v)[0]), "survival": lambda t: lambda *v: float(f.upper(np.array([t]), *v)[0])}
    for what, r in zip(asked, got, strict=True):
        psi = (lambda *v, k=f.params.index(what[0]): float(v[k])) if what[0] in f.params else plain[what[0]](*(what[1:] or (0,)))
        low, high = brute_interval(name, psi, x, seen, np.array(p))
        assert r["lower"] == pytest.approx(low, rel=2e-5, abs=2e-5) and r["upper"] == pytest.approx(high, rel=2e-5, abs=2e-5), what
        assert r["lower"] < r["estimate"] < r["upper"] and r["passes"] < 40
    assert profile.intervals(obs, {"family": name, "code": "EMPTY_SAMPLE"}, [("mean",)]) == [{"quantity": "mean", "reason": "NO_DATA"}]


def test_small_samples_have_wide_intervals(spark):
    x, seen = sample("weibull", 12, 3)
    obs = rows(spark, x, seen)
    fitted = newton_fit(obs, "weibull")
    (r,) = profile.intervals(obs, fitted, [("quantile", 0.99)])
    f = family("weibull")
    low, high = brute_interval("weibull", lambda *v: float(f.quantile(np.array([0.99]), *v)[0]), x, seen, np.array(list(fitted["params"].values())))
    assert r["lower"] == pytest.approx(low, rel=1e-4) and r["upper"] == pytest.approx(high, rel=1e-4)


def heavy(spark, name):
    """The interval of a first parameter, and its Wald ends, of 400 rows that stand for 400 million."""
    x, seen = sample(name)
    obs = rows(spark, x, seen).withColumn("weight", F.lit(10**6))
    fitted = newton_fit(obs, name)
    (r,) = profile.intervals(obs, fitted, [(family(name).params[0],)])
    return r, uncertainty.wald(fitted)[family(name).params[0]]


@pytest.mark.parametrize("name", ["gumbel", "lognormal", "weibull", "normal", "gamma"])
def test_ends_where_losses_are_small_beside_the_likelihood(spark, name):
    r, w = heavy(spark, name)
    width = w["upper"] - w["lower"]
    assert abs(r["lower"] - w["lower"]) < 1e-3 * width and abs(r["upper"] - w["upper"]) < 1e-3 * width


def frame(spark, x):
    return spark.createDataFrame([(float(v),) for v in x], "x double").repartition(3)


def test_student_t(spark):
    r = np.random.default_rng(3)
    x = 4 + 1.5 * r.standard_t(3.5, 3000)
    got = shapes.fit_student_t(frame(spark, x), "x")
    ll = lambda v, m, s: float(np.sum(family("student_t").logpdf(x, v, m, s)))
    v, m, s = got["params"].values()
    assert got["code"] == "OK" and got["loglik"] == pytest.approx(ll(v, m, s), rel=1e-10) and abs(v - 3.5) < 0.8
    for i in range(3):
        for step in (-1e-3, 1e-3):
            q = [v, m, s]
            q[i] += step
            assert ll(*q) < got["loglik"]
    held = shapes.fit_student_t(frame(spark, x), "x", degrees=5)
    assert held["params"]["df"] == pytest.approx(5) and held["passes"] < got["passes"] + 40
    assert shapes.fit_student_t(frame(spark, r.random(400)), "x")["code"] == "NORMAL_LIMIT"
    assert shapes.fit_student_t(frame(spark, []), "x")["code"] == "EMPTY_SAMPLE" and shapes.fit_student_t(frame(spark, [1, 1]), "x")["code"] == "DEGENERATE_SAMPLE"


def brute_l(x):
    x, n = np.sort(x), len(x)
    b = [np.mean([v * math.comb(i, k) / math.comb(n - 1, k) for i, v in enumerate(x)]) for k in range(4)]
    l2, l3, l4 = 2 * b[1] - b[0], 6 * b[2] - 6 * b[1] + b[0], 20 * b[3] - 30 * b[2] + 12 * b[1] - b[0]
    return b[0], l2, l3 / l2, l4 / l2


def test_l_moments(spark):
    r = np.random.default_rng(5)
    for x in (r.normal(size=500) + 1e6, r.integers(0, 9, 700).astype(float), r.exponential(size=5)):
        got = shapes.l_moments(frame(spark, x), "x").first()
        assert got["n"] == len(x) and [got[k] for k in ("l1", "l2", "t3", "t4")] == pytest.approx(brute_l(x), rel=1e-7, abs=1e-9)
    assert tuple(shapes.l_moments(frame(spark, [2, 2]), "x").first()) == (2, 2.0, 0.0, None, None)
    assert shapes.l_moments(frame(spark, []), "x").first()["l1"] is None


@pytest.mark.parametrize("shape", [-0.4, 0.0, 0.25])
def test_gev_by_l_moments(spark, shape):
    q = (np.arange(4000) + 0.5) / 4000
    x = np.asarray(family("gev").quantile(q, shape, 5.0, 2.0), float)
    got = shapes.fit_gev_lmoments(frame(spark, x), "x")
    assert got["code"] == "OK" and list(got["params"].values()) == pytest.approx([shape, 5.0, 2.0], abs=0.03)


def test_triangular_peak(spark):
    r = np.random.default_rng(7)
    for x, ends in ((r.triangular(1, 2, 6, 300), (1.0, 6.0)), (r.integers(1, 9, 500).astype(float), (0.0, 9.0)), (r.triangular(0, 0.2, 1, 200), (None, None))):
        got = shapes.fit_triangular(frame(spark, x), "x", *ends)
        low, peak, high = got["params"].values()
        ll = lambda c: float(np.sum(np.where(x <= c, np.log(2 * (x - low) / ((high - low) * (c - low))), np.log(2 * (high - x) / ((high - low) * (high - c))))))  # noqa: B023, E731
        every = [(ll(c), -c) for c in np.unique(x)]
        assert (got["loglik"], -peak) == pytest.approx(max(every), rel=1e-9) and all(ll(c) <= got["loglik"] + 1e-9 for c in np.linspace(low + 1e-3, high - 1e-3, 400))
    assert shapes.fit_triangular(frame(spark, [1, 2]), "x", 1.0, 3.0)["code"] == "INVALID_SUPPORT"


@pytest.mark.parametrize("name", ["weibull", "gumbel"])
def test_information_from_the_last_pass(spark, name):
    x, _ = sample(name, 500, censored=False)
    df = frame(spark, x)
    got = scale.information(scale.fit(df, "x", name))
    _, g, h = score.derivatives(profile.exact(df, "x"), name, list(got["params"].values()))
    assert np.allclose(g, 0, atol=1e-4) and np.allclose(np.array(got["information"]), -h, rtol=1e-4, atol=1e-3)
    assert got["free"] == list(family(name).params) and uncertainty.wald(got)["scale"]["se"] > 0


def test_degree_grows_until_the_surrogate_is_close(spark, monkeypatch):
    x, _ = sample("weibull", 300, censored=False)
    df = frame(spark, x)
    fitted = fit_weibull(df, "x")
    few = scale.WeibullProfile(df, "x", fitted, 1.0, degree=3)
    assert few.close and few.error * few.n <= 1e-3 and few.passes > 3
    monkeypatch.setattr(scale.WeibullProfile, "MOST_DEGREE", 3)
    assert not scale.WeibullProfile(df, "x", fitted, 3.0, degree=3).close

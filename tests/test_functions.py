"""Densities, probabilities and quantiles of all families against each other and against known values."""

import math

import numpy as np
import pytest
from quernel.functions import families, special

PARAMS = {
    "exponential": (2.0,), "weibull": (1.5, 2.0), "gumbel": (1.0, 2.0), "normal": (1.0, 2.0), "lognormal": (0.3, 0.7), "gamma": (2.5, 1.5), "uniform": (1.0, 3.0), "beta": (2.0, 3.0), "logistic": (1.0, 2.0), "pareto": (2.5, 1.0), "cauchy": (0.0, 1.0), "student_t": (5.0, 1.0, 2.0), "chi_square": (4.0,),
    "f": (5.0, 9.0), "laplace": (1.0, 2.0), "rayleigh": (2.0,), "wald": (2.0, 3.0), "triangular": (0.0, 1.0, 4.0), "burr": (2.0, 3.0, 1.0), "gev": (0.2, 1.0, 2.0), "poisson": (4.0,), "binomial": (10.0, 0.3), "negative_binomial": (3.0, 0.4), "geometric": (0.3,), "hypergeometric": (50.0, 20.0, 10.0),
}


@pytest.mark.parametrize("name", sorted(PARAMS))
def test_family(name):
    f, p = families.family(name), PARAMS[name]
    q = np.linspace(0.03, 0.97, 23)
    x = f.quantile(q, *p)
    if f.discrete:
        k = np.arange(0, 300.0)
        m = np.exp(f.logpdf(k, *p))
        assert abs(m.sum() - 1) < 1e-9 and np.allclose(np.cumsum(m), f.cdf(k, *p), atol=1e-9)
        assert np.all(f.cdf(x, *p) >= q - 1e-12) and np.all(f.cdf(x - 1, *p) < q)
    else:
        assert np.allclose(f.cdf(x, *p), q, atol=1e-9)
        h = 1e-6 * np.maximum(1, np.abs(x))
        slope = (f.cdf(x + h, *p) - f.cdf(x - h, *p)) / (2 * h)
        assert np.allclose(slope, np.exp(f.logpdf(x, *p)), rtol=2e-3, atol=1e-6)
    assert np.allclose(f.upper(x, *p), 1 - f.cdf(x, *p), atol=1e-12)
    if f.mean and f.var and name not in ("pareto", "f", "student_t"):
        y = f.sample(np.random.default_rng(1), 40000, *p)
        assert abs(y.mean() - f.mean(*p)) < 6 * math.sqrt(f.var(*p) / 40000)
        assert abs(y.var() / f.var(*p) - 1) < 0.15


def test_known_values():
    assert np.allclose(special.norm_ppf(np.array([0.025, 0.5, 0.975])), [-1.959963984540054, 0, 1.959963984540054], atol=1e-12)
    assert abs(float(special.chi2_ppf(0.95, 1)) - 3.841458820694124) < 1e-9
    assert abs(float(special.t_ppf(0.975, 5)) - 2.5705818356363146) < 1e-8
    assert abs(float(special.digamma(1.0)) + 0.5772156649015329) < 1e-12 and abs(float(special.trigamma(1.0)) - math.pi**2 / 6) < 1e-12
    assert abs(special.kolmogorov_sf(1.3580986) - 0.05) < 1e-6
    assert np.isclose(special.log_norm_cdf(-40.0), -804.608442, atol=1e-5)


def test_names():
    assert families.family("Gaussian").name == "normal" and families.family("weibull-min").name == "weibull"
    with pytest.raises(ValueError):
        families.family("nothing")


@pytest.mark.parametrize("name", sorted({k for k, _ in families.COLUMN}))
def test_columns_equal_arrays(spark, name):
    from pyspark.sql import functions as F

    f, p = families.family(name), PARAMS[name]
    q = np.linspace(0.05, 0.95, 19)
    x = np.asarray(f.quantile(q, *p), float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(q, x, strict=True)], "q double, x double")
    for op, call, arg in (("logpdf", f.logpdf, "x"), ("cdf", f.cdf, "x"), ("sf", f.upper, "x"), ("ppf", f.quantile, "q")):
        got = [r[0] for r in df.orderBy("q").select(families.column(name, op, arg, *p)).collect()]
        assert np.allclose(got, call(q if arg == "q" else x, *p), rtol=1e-9, atol=1e-9), op
    assert df.select(F.sum(families.column(name, "pdf", "x", *p))).first()[0] > 0


def test_incomplete_functions_end_at_rounding():
    """A continued fraction whose factors stay a rounding from 1 went on to its last step."""
    import time

    x = np.random.default_rng(0).exponential(2.5, 100_000)
    began = time.perf_counter()
    p, q = special.gamma_pq(2.5, x)
    special.beta_i(3.0, 4.5, np.minimum(x / 20, 1.0))
    assert time.perf_counter() - began < 3 and np.max(np.abs(p + q - 1)) < 1e-14

"""Moment tests, exact log-likelihoods and merged rows."""

import numpy as np
import pytest
from quernel.functions.families import family
from quernel.operators import moments
from quernel.operators.fit import exact_log_likelihood, log_likelihoods, newton_fit
from quernel.sources.observations import observations


def frame(spark, x, parts=3):
    return spark.createDataFrame([(float(v),) for v in x], "x double").repartition(parts)


def test_moment_test(spark, monkeypatch):
    monkeypatch.setattr(moments, "BLOCK", 300)  # a replicate of several blocks
    r = np.random.default_rng(1)
    x = r.gamma(2.0, 3.0, 1000)
    good = moments.moment_test(frame(spark, x), "x", "gamma", (2.0, 3.0), 99)
    z = (x - 6) / np.sqrt(18)
    want = [abs(z.mean()), abs(z.var() - 1), abs(((z - z.mean()) ** 3).mean() / z.std() ** 3 - 2 / np.sqrt(2)), abs(((z - z.mean()) ** 4).mean() / z.var() ** 2 - 3 - 3)]
    assert [good[k] for k in moments.GAPS] == pytest.approx(want, rel=1e-6) and min(good["p_values"].values()) > 0.01
    bad = moments.moment_test(frame(spark, x), "x", "normal", (6.0, np.sqrt(18)), 99)
    assert bad["p_values"]["skew_gap"] == 0.01 and bad["p_values"]["kurt_gap"] <= 0.02
    again = moments.moment_test(frame(spark, x, 5), "x", "gamma", (2.0, 3.0), 99)
    assert again["p_values"] == good["p_values"]
    assert moments.moment_test(frame(spark, []), "x", "normal", (0.0, 1.0))["code"] == "EMPTY_SAMPLE" and moments.moment_test(frame(spark, x), "x", "cauchy", (0.0, 1.0))["code"] == "NO_MOMENTS"


def test_p_values_are_even(spark):
    """Samples of the family itself give p-values below 0.2 about as often as they should."""
    low = 0
    for k in range(12):
        x = family("weibull").sample(np.random.default_rng(k), 200, 1.5, 2.0)
        low += moments.moment_test(frame(spark, x, 1), "x", "weibull", (1.5, 2.0), 49, seed=k)["p_values"]["mean_gap"] <= 0.2
    assert low <= 7


def test_exact_log_likelihood(spark):
    r = np.random.default_rng(2)
    obs = observations(frame(spark, r.exponential(3.0, 500)), "x")
    one = exact_log_likelihood(obs, "weibull", (1.2, 3.0))
    assert one == exact_log_likelihood(obs.repartition(7), "weibull", (1.2, 3.0)) == exact_log_likelihood(obs.coalesce(1), "weibull", (1.2, 3.0))
    assert one == pytest.approx(log_likelihoods(obs, "weibull", [(1.2, 3.0)])[1][0], rel=1e-12)


def test_merged_rows_give_the_same_fit(spark):
    x = np.random.default_rng(3).integers(1, 9, 600).astype(float)
    obs = observations(frame(spark, x), "x")
    a, b = newton_fit(obs, "gamma"), newton_fit(obs, "gamma", merged=True)
    assert b["n"] <= 8 and a["loglik"] == pytest.approx(b["loglik"], rel=1e-10) and list(a["params"].values()) == pytest.approx(list(b["params"].values()), rel=1e-7)

"""Leave-one-out by two steps against refits."""

import numpy as np
import pytest
from quernel.functions.families import family
from quernel.operators import loo, score
from quernel.operators.fit import newton_fit
from quernel.operators.profile import exact

TRUE = {"weibull": (1.6, 3.0), "gumbel": (2.0, 1.5), "normal": (1.0, 2.0), "lognormal": (0.3, 0.8), "gamma": (2.3, 1.7)}


@pytest.mark.parametrize("name", sorted(TRUE))
def test_equals_refits(spark, name):
    r = np.random.default_rng(2)
    x = np.asarray(family(name).quantile(r.random(300), *TRUE[name]), float)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(2).cache()
    fitted = newton_fit(exact(df, "x"), name)
    obs = exact(df, "x")
    rows = {q["value"]: q for q in loo.scored_rows(df, "x", fitted).collect()}
    picked = [*sorted(x)[:4], *sorted(x)[-4:], *x[:16]]
    brute = loo.refitted(obs, name, list(fitted["params"].values()), picked, score.admissible(obs))
    for v, want in zip(picked, brute):
        got = rows[v]
        assert abs(got["lpd"] - want) <= max(1e-7, 4 * got["left"]), (v, got, want)
    assert np.median([q["left"] for q in rows.values()]) < 1e-6


def test_refits_are_fits_to_all_others(spark):
    r = np.random.default_rng(3)
    x = np.asarray(family("gamma").quantile(r.random(60), 2.3, 1.7), float)
    obs = exact(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").cache()
    whole = newton_fit(obs, "gamma")
    for v in (x.min(), x.max()):
        less = newton_fit(obs.filter(f"value <> {float(v)!r}D"), "gamma")
        (got,) = loo.refitted(obs, "gamma", list(whole["params"].values()), [float(v)], score.admissible(obs))
        assert got == pytest.approx(float(family("gamma").logpdf(np.array([v]), *less["params"].values())[0]), abs=1e-8)


def test_sum_and_codes(spark):
    r = np.random.default_rng(4)
    x = r.normal(3, 2, 200)
    df = spark.createDataFrame([(float(v),) for v in [*x, x[0]]], "x double")
    got, n = loo.leave_one_out(df, "x", "normal"), 201
    y = np.append(x, x[0])
    want = 0.0
    for i in range(n):
        z = np.delete(y, i)
        want += 0.5 * np.log(2 * np.pi * z.var()) + (y[i] - z.mean()) ** 2 / (2 * z.var())
    assert got["code"] == "OK" and got["loo"] == pytest.approx(want, abs=1e-5) and got["refits"] < n
    assert loo.leave_one_out(df, "x", "normal", tol=1e-300, most_refits=5)["code"] == "TOO_MANY_REFITS"
    assert loo.leave_one_out(df, "x", "weibull")["code"] == "INVALID_SUPPORT" and loo.leave_one_out(df.limit(0), "x", "gumbel")["code"] == "EMPTY_SAMPLE"

"""Fits recover parameters, statistics equal brute force, and exact sums don't depend on partitions."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from quernel.functions.families import family
from quernel.operators import exact, fit, gof, ranking, samples, score, uncertainty
from quernel.sources import lifetime_csv, partitions
from quernel.sources.observations import CapabilityError, cell, numeric_violations, observations, violations
from quernel.streaming import fits as streams


def frame(spark, x, name="x"):
    return spark.createDataFrame([(float(v),) for v in x], f"{name} double")


def grid(name, p, n=1500):
    return family(name).quantile((np.arange(n) + 0.5) / n, *p)


@pytest.mark.parametrize("name,p", [("weibull", (1.5, 100.0)), ("gumbel", (10.0, 3.0))])
def test_profile_fits(spark, name, p):
    df = frame(spark, grid(name, p))
    r = (fit.fit_weibull if name == "weibull" else fit.fit_gumbel)(df, "x")
    got = [r[k] for k in family(name).params]
    assert np.allclose(got, p, rtol=0.02) and r["passes"] <= 17
    one = fit.newton_fit(observations(df, "x"), name)
    assert np.allclose(list(one["params"].values()), got, rtol=1e-4) and abs(one["loglik"] - r["loglik"]) < 1e-3


def test_pass_budget(spark):
    with pytest.raises(fit.PassBudgetError):
        fit.fit_weibull(frame(spark, grid("weibull", (1.5, 10.0), 100)), "x", budget=2)


@pytest.mark.parametrize("name,p", [("gamma", (2.0, 3.0)), ("beta", (2.0, 5.0)), ("logistic", (4.0, 2.0)), ("wald", (2.0, 5.0))])
def test_newton_recovers(spark, name, p):
    r = fit.newton_fit(observations(frame(spark, grid(name, p, 800)), "x"), name)
    assert r["code"] == "OK" and np.allclose(list(r["params"].values()), p, rtol=0.06)


def test_gamma_without_passes(spark):
    x = grid("gamma", (2.0, 3.0), 500)
    r = fit.fit_gamma(frame(spark, x), "x").first()
    g = gof._gamma(x)
    assert np.allclose([r["shape"], r["scale"]], g, rtol=1e-9)


def test_censored_exponential_equals_closed_form(spark):
    rng = np.random.default_rng(3)
    t, c = rng.exponential(10, 400), rng.exponential(20, 400)
    df = spark.createDataFrame([(float(min(a, b)), bool(a <= b)) for a, b in zip(t, c, strict=True)], "t double, e boolean")
    a = fit.fit_exponential_censored(df, "t", "e").first()
    b = fit.newton_fit(observations(df, "t", event="e"), "exponential")
    assert abs(a["rate"] - b["params"]["rate"]) < 1e-6 * a["rate"] and abs(a["loglik"] - b["loglik"]) < 1e-6


def test_failure_codes(spark):
    none = spark.createDataFrame([], "x double")
    assert {r["code"] for r in fit.fit_closed(none, "x", ["normal", "exponential"]).collect()} == {"EMPTY_SAMPLE"}
    assert fit.fit_closed(frame(spark, [2.0, 2.0]), "x", ["normal"]).first()["code"] == "DEGENERATE_SAMPLE"
    assert fit.fit_weibull(frame(spark, [-1.0, 2.0]), "x")["code"] == "INVALID_SUPPORT"
    no = spark.createDataFrame([(1.0, False)], "t double, e boolean")
    assert fit.fit_exponential_censored(no, "t", "e").first()["code"] == "NO_OBSERVED_EVENTS"


def test_edf_with_ties(spark):
    x = np.round(np.random.default_rng(1).exponential(5, 300), 0) + 0.5
    r = gof.edf_statistics(frame(spark, x), "x", "exponential", (0.2,)).first()
    assert np.allclose([r["ks"], r["ad"], r["cvm"]], gof.small_statistics(x, "exponential", (0.2,)), rtol=1e-9)


def test_large_sample_bounds_hold_ks(spark):
    x = np.random.default_rng(2).exponential(5, 3000)
    ks = gof.small_statistics(x, "exponential", (0.2,))[0]
    r = gof.large_sample(frame(spark, x), "x", "exponential", (0.2,), 0.1)
    assert r["ks_lower"] <= ks <= r["ks_upper"] and r["ks_upper"] - r["ks_lower"] < 0.002 and r["decision"] == "PASS"


def test_monte_carlo_is_reproducible(spark):
    df = frame(spark, np.random.default_rng(4).exponential(5, 60))
    a = sorted(map(tuple, gof.monte_carlo(df, "x", "exponential", 20, seed=9).collect()))
    b = sorted(map(tuple, gof.monte_carlo(df.repartition(3), "x", "exponential", 20, seed=9).collect()))
    assert [r[0] for r in a] == ["ad", "cvm", "ks"] and np.allclose([r[2] for r in a], [r[2] for r in b])
    with pytest.raises(gof.RefitRefused):
        gof.monte_carlo(df, "x", "exponential", 5, most_rows=10)


def test_exact_sum(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=500) * 10.0 ** rng.integers(-200, 200, 500)
    true = sum(map(Fraction, x.tolist()), Fraction(0))
    sums = {exact.exact_sum(frame(spark, x).repartition(k), "x") for k in (1, 3, 7)}
    assert sums == {true}
    y = rng.normal(size=200)
    assert exact.exact_sum(frame(spark, y), "x", squares=True) == sum((Fraction(v) ** 2 for v in y.tolist()), Fraction(0))


def test_ranks(spark):
    x = [3.0, 1.0, 3.0, 2.0, 1.0, 1.0]
    r, n = ranking.tied_ranks(frame(spark, x), "x")
    assert n == 6 and sorted(map(tuple, r.collect())) == [(1.0, 3, 0), (2.0, 1, 3), (3.0, 2, 4)]


def test_uncertainty(spark):
    x = np.random.default_rng(6).weibull(1.5, 400) * 10
    f = fit.newton_fit(observations(frame(spark, x), "x"), "weibull")
    w = uncertainty.wald(f)
    assert w["shape"]["lower"] < f["params"]["shape"] < w["shape"]["upper"]
    q = uncertainty.derived_quantile(f, 0.5)
    assert q["lower"] < q["estimate"] < q["upper"]
    assert 0 < uncertainty.derived_survival(f, 10.0)["lower"] < 1
    low, high = uncertainty.exact_rate(10, 50.0)
    p = uncertainty.profile_rate(10, 50.0)
    assert low < p["lower"] < 0.2 < p["upper"] < high * 1.05
    assert uncertainty.profile_rate(1, 1e-3)["upper"] > 1000
    fixed = fit.newton_fit(observations(frame(spark, x), "x"), "weibull", fixed={0: 1.5})
    assert uncertainty.wald(fixed)["shape"]["reason"] == "FIXED_PARAMETER" and uncertainty.wald({"code": "EMPTY_SAMPLE", "params": {"a": 1}})["a"]["reason"] == "NO_DATA"


def test_intervals_of_replicates():
    v = np.random.default_rng(1).normal(5, 1, 2000)
    for m in ("percentile", "basic", "student", "bca"):
        a, b = samples.bootstrap_interval(v, 5.0, method=m, jackknife=v[:200])
        assert 2.7 < a < 3.4 and 6.6 < b < 7.3


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.range(300).withColumn("x", F.col("id") * 0.5)
    one = sorted(map(tuple, samples.poisson_bootstrap(df, "x", 10, key="id").select("replicate", "n").collect()))
    two = sorted(map(tuple, samples.poisson_bootstrap(df.repartition(7), "x", 10, key="id").select("replicate", "n").collect()))
    assert one == two and abs(np.mean([r[1] for r in one]) - 300) < 30


def test_observation_checks(spark):
    rows = [(1.0, 1, None, None, None, 1.0), (float("nan"), 1, None, None, None, 1.0), (-1.0, 1, None, None, None, 1.0), (1.0, 3, 1.0, None, None, 1.0), (1.0, 0, 2.0, None, None, 1.0), (5.0, 1, None, 6.0, None, 1.0), (5.0, 1, None, 6.0, 6.0, 1.0), (5.0, 1, None, None, None, -1.0), (None, 1, None, None, None, 1.0)]
    o = spark.createDataFrame(rows, "value double, status int, upper double, trunc_lower double, trunc_upper double, weight double")
    got = {r["code"]: r["rows"] for r in violations(o).collect()}
    assert got == {"NAN_VALUE": 1, "NEGATIVE_TIME": 1, "BAD_INTERVAL": 1, "UPPER_OFF_INTERVAL": 1, "OUTSIDE_WINDOW": 1, "EMPTY_WINDOW": 1, "BAD_WEIGHT": 1, "NULL_VALUE": 1}
    big = spark.createDataFrame([(2**53 + 1,), (5,)], "x bigint")
    assert numeric_violations(big, "x").first()["code"] == "LOSSY_CAST"
    with pytest.raises(CapabilityError):
        numeric_violations(spark.createDataFrame([("a",)], "x string"), "x")
    assert cell("right", "none", "frequency", "fit") == "supported" and cell("left", "none", "analytic", "fit") != "supported"


def test_truncated_normal_fit(spark):
    x = np.random.default_rng(8).normal(10, 3, 3000)
    df = frame(spark, x[x > 9]).withColumn("lo", F.lit(9.0))
    r = fit.newton_fit(observations(df, "x", trunc_lower="lo"), "normal")
    assert abs(r["params"]["mu"] - 10) < 0.8 and abs(r["params"]["sigma"] - 3) < 0.5


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("time,event_observed\n1.5,1\n2e1,0\n")
    assert sorted(map(tuple, lifetime_csv.read_lifetimes(spark, str(p)).collect())) == [(1.5, True), (20.0, False)]
    for body in ("time,event\n1,1\n", "time,event_observed\n01,1\n", "time,event_observed\n1,2\n", "time,event_observed\n1,1,1\n", "time,event_observed\n-1,1\n"):
        p.write_text(body)
        with pytest.raises(lifetime_csv.CsvRefused):
            lifetime_csv.read_lifetimes(spark, str(p))


def test_incremental(spark, tmp_path):
    data, store = str(tmp_path / "d"), str(tmp_path / "s")
    spark.createDataFrame([(1.0,), (3.0,)], "x double").coalesce(1).write.parquet(data + "/a")
    r, seen = partitions.incremental(spark, data, "x", store)
    assert r.first()["n"] == 2 and seen == {"added": 1}
    spark.createDataFrame([(8.0,)], "x double").coalesce(1).write.parquet(data + "/b")
    r, seen = partitions.incremental(spark, data, "x", store)
    assert r.first()["mu"] == 4.0 and seen == {"added": 1, "kept": 1}
    spark.createDataFrame([(9.0,)], "x double").coalesce(1).write.mode("overwrite").parquet(data + "/b")
    with pytest.raises(partitions.ResumeRefused):
        partitions.incremental(spark, data, "x", store)


def test_resumable_stream(spark, tmp_path):
    data = str(tmp_path / "in")
    schema = "x double"
    for k in (1.0, 3.0):
        spark.createDataFrame([(k,)], schema).coalesce(1).write.mode("append").parquet(data)
        stream = spark.readStream.schema(schema).parquet(data)
        streams.resumable_fit(stream, "x", str(tmp_path / "cp"), str(tmp_path / "store")).awaitTermination()
    r = streams.stored_fit(spark, str(tmp_path / "store")).first()
    assert (r["n"], r["exposure"], r["rate"]) == (2, 4.0, 0.5)


def test_delivery_faults(spark):
    c = spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("a", 10, 12), ("b", 0, 5), ("b", 3, 8), ("c", 0, 2), ("c", 0, 2)], "source string, row_start long, row_stop long")
    assert sorted(map(tuple, streams.delivery_faults(c).collect())) == [("a", 10, "GAP"), ("b", 3, "OVERLAP"), ("c", 0, "DUPLICATE")]


def test_kaplan_meier_counts_those_censored_between(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, 1), (4.0, 1)], "t double, e int")
    got = [(r["time"], r["at_risk"], round(r["survival"], 6)) for r in samples.kaplan_meier(df, "t", "e").orderBy("time").collect()]
    assert got == [(1.0, 4, 0.75), (3.0, 2, 0.375), (4.0, 1, 0.0)]


def test_mixture_step_far_out(spark):
    x = np.array([0.0, 100.0, 2000.0, 5000.0])
    parts = [(0.5, 20.0, 15.0), (0.5, 90.0, 40.0)]
    logs = np.array([np.log(w / s) - 0.5 * ((x - m) / s) ** 2 for w, m, s in parts])
    r = np.exp(logs - logs.max(axis=0))
    r /= r.sum(axis=0)
    got = samples.mixture_step(frame(spark, x), "x", parts).orderBy("component").collect()
    assert np.allclose([(g["weight"], g["mu"]) for g in got], np.stack([r.mean(axis=1), (r * x).sum(axis=1) / r.sum(axis=1)], axis=1))


def test_mixture(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 500), rng.normal(10, 2, 500)])
    parts = sorted(samples.mixture(frame(spark, x).cache(), "x", 2, steps=15), key=lambda p: p[1])
    assert abs(parts[0][1]) < 0.3 and abs(parts[1][1] - 10) < 0.5 and abs(parts[0][0] - 0.5) < 0.05


def test_deviance_residuals_are_defined_where_density_exceeds_one(spark):
    r = samples.residuals(frame(spark, [0.0, 0.01, 0.05]), "x", "normal", (0.01, 0.01)).collect()
    assert all(math.isfinite(v["deviance_residual"]) for v in r) and r[0]["deviance_residual"] < 0 < r[2]["deviance_residual"]


def test_best_of(spark):
    out = samples.best_of(frame(spark, grid("lognormal", (1.0, 0.5), 400)), "x", ["exponential", "lognormal", "gamma"])
    assert out[0]["family"] == "lognormal" and all(r["code"] == "OK" for r in out)


def test_quantiles_by_ranks_equal_percentiles(spark):
    x = np.round(np.random.default_rng(9).exponential(3, 400), 1)
    p = [0.0, 0.1, 0.25, 0.5, 0.731, 0.99, 1.0]
    df = frame(spark, x)
    for few in (10**6, 10):
        assert np.allclose(ranking.quantiles(df, "x", p, few), np.quantile(x, p))
    assert ranking.quantiles(df.limit(0), "x", [0.5]) == [None]


def test_grouped_summary(spark):
    df = spark.range(100).selectExpr("id % 3 as g", "cast(id as double) as x")
    r = samples.describe(df, "x", by=["g"]).orderBy("g").collect()
    assert [v["n"] for v in r] == [34, 33, 33] and r[0]["median"] == 49.5
    f = fit.fit_closed(df, "x", ["laplace", "normal"], by=["g"]).filter("family = 'laplace'").orderBy("g").first()
    assert f["p1"] == 49.5


def test_equal_values_are_degenerate_however_they_are_dealt(spark):
    """Merged means of 7.0 need not be 7.0, as 7 / n * n is not for these n."""
    n = [k for k in range(2, 2000) if 7.0 / k * k != 7.0][-1]
    df = spark.range(0, 3 * n, 1, 3).selectExpr("7.0D as x")
    assert {r["family"]: r["code"] for r in fit.fit_closed(df, "x", ["exponential", "normal", "lognormal"]).collect()} == {"exponential": "OK", "normal": "DEGENERATE_SAMPLE", "lognormal": "DEGENERATE_SAMPLE"}


def test_leave_one_out_far_from_zero(spark):
    df = spark.range(0, 2_000_000, 1, 2).selectExpr("1e9D + (id % 1000) * 0.0001D as x", "(1e9D + (id % 1000) * 0.0001D) - 1e9D as near")
    far, near = (samples.leave_one_out(df, c, "normal").first()["loo"] for c in ("x", "near"))
    assert abs(far - near) < 0.05


def test_hazard_of_the_normal_tail(spark):
    z = np.concatenate([np.linspace(-9, 12, 300), [0.0, 25.0, 200.0]])
    frame = spark.createDataFrame([(float(v),) for v in z], "z double").select("z", score.mills(F.col("z")).alias("m"))
    assert "lambda" not in frame._jdf.queryExecution().toString()  # loops over rows are not compiled
    for v, m in frame.collect():
        want = math.exp(-v * v / 2) / math.sqrt(2 * math.pi) / (0.5 * math.erfc(v / math.sqrt(2))) if v < 20 else v + 1 / (v + 2 / (v + 3 / (v + 4 / v)))
        assert abs(m / want - 1) < 1e-9

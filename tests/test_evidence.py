"""Kernels, strict CSV, passes that resume, coverage, profile intervals and exact sums against closed forms and brute force."""

import math
from decimal import Decimal, getcontext
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from quernel.functions import special as sp
from quernel.functions.families import column, log_cdf, log_sf
from quernel.functions.likelihood import contributions, log_window
from quernel.operators import assess, evidence, exact, fit, gof, samples, scale
from quernel.operators.ranking import grouped_quantiles, quantiles
from quernel.sources import lifetime_csv as csv
from quernel.sources import partitions
from quernel.sources.observations import CapabilityError
from quernel.streaming import fits as streams

getcontext().prec = 80
NAN = float("nan")


def one(name, params, value, status, upper=NAN, lo=NAN, hi=NAN):
    return contributions(name, params, *(np.array([float(v)]) for v in (value, status, upper, lo, hi)))[0]


def tails(name):
    """Exact cdf and sf as Decimals."""
    return {
        "exponential": lambda x: (1 - (-x).exp(), (-x).exp()),
        "weibull": lambda x: (1 - (-(x * x.sqrt())).exp(), (-(x * x.sqrt())).exp()),  # shape 1.5
        "gumbel": lambda x: ((-(-x).exp()).exp(), 1 - (-(-x).exp()).exp()),
        "gamma": lambda x: (1 - (1 + x) * (-x).exp(), (1 + x) * (-x).exp()),  # shape 2
        "logistic": lambda x: (1 / (1 + (-x).exp()), 1 / (1 + x.exp())),
    }[name]


PARAMS = {"exponential": (1.0,), "weibull": (1.5, 1.0), "gumbel": (0.0, 1.0), "gamma": (2.0, 1.0), "logistic": (0.0, 1.0)}


@pytest.mark.parametrize("name", sorted(PARAMS))
def test_windows_on_a_grid(name):
    """Near and far, narrow and wide, with every kind of observation and window."""
    exact_tails, p = tails(name), PARAMS[name]
    for start in (1e-6, 0.7, 6.0, 30.0):
        for width in (1e-9, 0.3, 4.0):
            a, b = start, start + width
            (ca, sa), (cb, sb) = exact_tails(Decimal(a)), exact_tails(Decimal(b))
            want = float((sa - sb).ln()) if sa < ca else float((cb - ca).ln())
            assert log_window(name, a, b, *p) == pytest.approx(want, rel=1e-9, abs=1e-12)
            assert one(name, p, a, 3, upper=b) == pytest.approx(want, rel=1e-9, abs=1e-12)
            lo = start / 2
            floor = exact_tails(Decimal(lo))[1]
            assert one(name, p, a, 0, lo=lo) == pytest.approx(float((sa / floor).ln()), rel=1e-9, abs=1e-12)
            assert one(name, p, a, 2, lo=lo) == pytest.approx(float(((ca - exact_tails(Decimal(lo))[0]) / floor).ln()), rel=1e-9, abs=1e-9)
        assert log_cdf(name, np.array([start]), *p)[0] == pytest.approx(float(ca.ln()), rel=1e-11)
        assert log_sf(name, np.array([start]), *p)[0] == pytest.approx(float(sa.ln()), rel=1e-11)


def test_far_tails():
    assert one("exponential", (1.0,), 1000, 0) == -1000 and one("exponential", (1.0,), 1000.5, 0, lo=1000) == -0.5
    assert one("normal", (0.0, 1.0), 9.0005, 1, lo=9, hi=9.001) == pytest.approx(math.log(1000), abs=1e-3)
    assert one("exponential", (1.0,), 5, 3, upper=5) == -math.inf
    z = np.array([40.0, 100.0, 1e4])
    assert np.allclose(sp.log_norm_cdf(-z), -0.5 * z * z - np.log(z) - 0.5 * math.log(2 * math.pi) + np.log1p(-1 / z**2 + 3 / z**4), rtol=1e-13)
    assert sp.inverse_mills(50.0) == pytest.approx(50.01998401, rel=1e-9)
    assert sp.log1pmx(np.array([1e-8]))[0] == pytest.approx(-5e-17, rel=1e-7) and sp.log1pmx(np.array([0.5]))[0] == pytest.approx(math.log(1.5) - 0.5, rel=1e-14)
    assert sp.stirling_error(np.array([20.0]))[0] == pytest.approx(math.lgamma(20) - 19.5 * math.log(20) + 20 - 0.5 * math.log(2 * math.pi), abs=1e-14)
    assert sp.log_ratio(1e-300, 1e300) == pytest.approx(-600 * math.log(10)) and sp.log_gamma_pq(3.0, 900.0)[1] == pytest.approx(-900 + math.log(1 + 900 + 900**2 / 2))


def test_column_tails(spark):
    d = spark.createDataFrame([(0.5,), (900.0,)], "x double")
    r = d.select(column("exponential", "logsf", "x", 2.0), column("gamma", "logsf", "x", 2.0, 1.0), column("logistic", "isf", F.lit(0.25), 0.0, 1.0), column("poisson", "pmf", F.lit(3.0), 2.0)).collect()
    assert r[1][0] == -1800 and r[1][1] == pytest.approx(-900 + math.log(901)) and r[0][2] == pytest.approx(math.log(3)) and r[0][3] == pytest.approx(8 / 6 * math.exp(-2))


def test_kolmogorov():
    assert sp.kolmogorov_exact(0.274, 10) == pytest.approx(1 - 0.6284796154565, abs=1e-11)
    assert sp.kolmogorov_one_sided(0.3, 1) == pytest.approx(0.7) and sp.kolmogorov_exact(0.6, 1) == pytest.approx(0.8)
    rng = np.random.default_rng(1)
    u = np.sort(rng.random((20000, 12)), axis=1)
    d = np.maximum((np.arange(1, 13) / 12 - u).max(axis=1), (u - np.arange(12) / 12).max(axis=1))
    assert (d >= 0.3).mean() == pytest.approx(sp.kolmogorov_exact(0.3, 12), abs=0.01)
    assert ((np.arange(1, 13) / 12 - u).max(axis=1) >= 0.25).mean() == pytest.approx(sp.kolmogorov_one_sided(0.25, 12), abs=0.01)


def test_ks_test_tells_the_place(spark):
    d = spark.createDataFrame([(v,) for v in (0.1, 0.2, 0.2, 0.9)], "x double")
    r = gof.ks_test(d, "x", "uniform", (0.0, 1.0))
    assert (r["side"], r["place"], r["n"]) == ("plus", 0.2, 4) and r["statistic"] == pytest.approx(0.55)
    assert r["p_value"] == pytest.approx(sp.kolmogorov_exact(0.55, 4)) and gof.ks_test(d, "x", "uniform", (0.0, 1.0), "minus")["place"] == 0.9
    assert gof.ks_test(d.limit(0), "x", "uniform", (0.0, 1.0))["n"] == 0


@pytest.mark.parametrize("content,reason", [
    (b"time,event_observed\n1,1\n0.5,0\n1.25e+1,0\n", 3), (b"\xef\xbb\xbftime,event_observed\r\n0,1\r\n1.25e+1,0\r\n", 2), (b"time,event_observed\n1,1\n\n\n", 1), (b"time,event_observed\n", 0),
    (b"", "HEADER"), (b"\xff", "ENCODING"), (b"time,time\n1,1\n", "HEADER"), (b"1,1\n2,0\ntime,event_observed\n", "HEADER"), (b"time,event_observed\n1,1\ntime,event_observed\n", "TIME"), (b"time,event_observed\n\n1,1\n", "BLANK"),
    (b"time,event_observed\n" + b"1,1\n" * 90 + b"\n" + b"2,0\n" * 60, "BLANK"), (b"time,event_observed\n1,1,x\n", "FIELDS"), (b'time,event_observed\n"u,1\n', "TIME"), (b"time,event_observed\n1,\xff\n", "ENCODING"),
    *[(b"time,event_observed\n" + v + b",1\n", "TIME") for v in (b" 1", b"+1", b"01", b".5", b"1.", b"NaN", b"Inf", b"1e-999999")], *[(b"time,event_observed\n1," + v + b"\n", "EVENT") for v in (b" 1", b"1 ", b"01", b"true")],
])
def test_strict_csv(spark, tmp_path, content, reason):
    path = tmp_path / "x.csv"
    path.write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")  # several splits of one file
    try:
        if isinstance(reason, int):
            assert csv.read_lifetimes(spark, str(path)).count() == reason
        else:
            with pytest.raises(csv.CsvRefused, match=reason):
                csv.read_lifetimes(spark, str(path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_checkpointed_csv(spark, tmp_path):
    data, store = tmp_path / "data", str(tmp_path / "store")
    data.mkdir()
    for k in range(3):
        (data / f"{k}.csv").write_text("time,event_observed\n" + f"{k + 1},1\n" * 4)
    stops = iter([False, True])
    r = csv.checkpointed_fit(spark, str(data), store, "s", files_each=1, cancel=lambda: next(stops))
    assert (r["code"], r["files_done"], r["n"]) == ("CANCELLED", 1, 4)
    r = csv.checkpointed_fit(spark, str(data), store, "s", files_each=1)
    assert (r["code"], r["files_done"], r["n"], r["events"], r["exposure"]) == ("COMPLETE", 3, 12, 12, 24.0)
    assert csv.checkpointed_fit(spark, str(data), store, "s")["steps"] == 3
    assert csv.checkpointed_fit(spark, str(data), store, "other")["code"] == "SOURCE_MISMATCH"
    (data / "1.csv").write_text("time,event_observed\n9,1\n")
    assert csv.checkpointed_fit(spark, str(data), store, "s")["code"] == "REVISION_MISMATCH"


def test_fit_at_scale_resumes(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").filter("value > 0")
    store = str(tmp_path / "passes")
    with pytest.raises(fit.PassBudgetError):
        fit.fit_weibull(e, "value", budget=1)
    r = scale.fit(e, "value", "weibull", store=store)
    assert r["code"] == "OK" and r["passes"] == len(r["ledger"]) <= 6 and r["reused"] == 0
    again = scale.fit(e, "value", "weibull", store=store, resume=True)
    assert again["reused"] == again["passes"] and again["params"] == r["params"]
    with pytest.raises(partitions.ResumeRefused, match="JOB_CHANGED"):
        scale.fit(e, "value", "gumbel", store=store, resume=True)
    with pytest.raises(partitions.ResumeRefused, match="STORE_IN_USE"):
        scale.fit(e, "value", "weibull", store=store)
    with pytest.raises(ValueError):
        scale.fit(e, "value", "weibull", pass_budget=2)
    with pytest.raises(CapabilityError):
        scale.fit(e, "value", "beta")
    assert scale.fit(e, "value", "gumbel")["passes"] <= 6 and scale.fit(e.limit(0), "value", "gamma")["code"] == "EMPTY_SAMPLE"
    assert "weibull" in evidence.summary(r) and "median" in evidence.explain(r) and '"family":"weibull"' in evidence.result_json(r)


def test_incremental_generations(spark, tmp_path):
    path, store = str(tmp_path / "in"), str(tmp_path / "store")
    put = lambda v: spark.createDataFrame([(float(x),) for x in v], "x double").coalesce(1).write.mode("append").parquet(path)
    put([1e9, 1e9 + 0.1])
    r, seen = partitions.incremental(spark, path, "x", store)
    assert seen == {"added": 1} and r.first()["sigma"] == pytest.approx(0.05, rel=1e-6)
    put([1e9 + 0.2])
    (tmp_path / "store" / "generation=2").mkdir()  # left by a run that broke off
    r, seen = partitions.incremental(spark, path, "x", store)
    assert seen == {"kept": 1, "added": 1} and r.first()["n"] == 3 and partitions.generations(spark, store) == [1, 2]
    assert partitions.fingerprints(spark, path, content=True).count() == 2


def brute_weibull(x, quantity, level=0.95):
    """Profile interval by a dense search over both parameters."""
    n, logs = len(x), np.log(x)

    def loglik(k, ls):
        return n * (np.log(k) - k * ls) + (k - 1) * logs.sum() - np.exp(k * (logs - ls)).sum()

    ks = np.exp(np.linspace(math.log(0.9), math.log(2.4), 3001))
    k_best = ks[np.argmax([loglik(k, math.log(np.mean(x**k)) / k) for k in ks])]
    limit = loglik(k_best, math.log(np.mean(x**k_best)) / k_best) - 3.841458820694124 / 2
    lnsum = np.array([math.log(np.mean(x**k)) for k in ks])

    def best(u):
        ls = {"mean": u - np.array([math.lgamma(1 + 1 / k) for k in ks]), "quantile": u - math.log(-math.log(0.9)) / ks, "scale": u + 0 * ks, "survival": math.log(5.0) - u / ks}[quantity]
        return (n * (np.log(ks) - ks * ls) + (ks - 1) * logs.sum() - n * np.exp(lnsum - ks * ls)).max()

    s = math.log(np.mean(x**k_best)) / k_best
    at = {"mean": s + math.lgamma(1 + 1 / k_best), "quantile": s + math.log(-math.log(0.9)) / k_best, "scale": s, "survival": k_best * (math.log(5.0) - s)}[quantity]
    ends = []
    for side in (-1, 1):
        a, b = at, at + side * 1.0
        for _ in range(50):
            m = (a + b) / 2
            a, b = (m, b) if best(m) >= limit else (a, m)
        ends.append(a)
    return sorted(math.exp(-math.exp(v)) if quantity == "survival" else math.exp(v) for v in ends)


def test_weibull_profiles_equal_a_dense_search(spark):
    x = 10 * np.random.default_rng(4).weibull(1.5, 120)
    d = spark.createDataFrame([(float(v),) for v in x], "x double").persist()
    got = scale.weibull_intervals(d, "x", fit.fit_weibull(d, "x"), [("shape",), ("scale",), ("mean",), ("quantile", 0.1), ("survival", 5.0)])
    for r in got[1:]:
        assert (r["lower"], r["upper"]) == pytest.approx(brute_weibull(x, r["quantity"]), rel=2e-4)
        assert r["lower"] < r["estimate"] < r["upper"] and r["surrogate_error"] < 1e-8
    shape = assess.profile_shape(d, "x", fit.fit_weibull(d, "x"))
    assert (got[0]["lower"], got[0]["upper"]) == pytest.approx((shape["lower"], shape["upper"]), rel=1e-5)


def test_exact_sums(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-300, 300, 3000), [5e-324, -5e-324, 1e308, -1e308, 0.0, 1e200, 3e-200]])
    d = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(7)
    assert exact.exact_sum(d, "x") == sum(map(Fraction, x.tolist())) and exact.exact_sum(d, "x", squares=True) == sum(Fraction(v) ** 2 for v in x.tolist())
    assert exact.exact_sum(d.limit(0), "x") == 0
    with pytest.raises(Exception, match="finite"):
        exact.exact_sum(spark.createDataFrame([(math.inf,)], "x double"), "x")


def test_quantiles_narrow_down(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.round(rng.normal(size=9000), 3), np.full(6000, 0.25), rng.exponential(size=3000) * 1e6])
    d = spark.createDataFrame([(float(v), int(k % 3) if k % 7 else None) for k, v in enumerate(x)], "x double, g int")
    probs = [0.0, 0.001, 0.25, 0.5, 0.77, 0.999, 1.0]
    assert quantiles(d, "x", probs, 50) == pytest.approx(np.quantile(x, probs).tolist())
    assert quantiles(d.limit(0), "x", [0.5]) == [None]
    got = {r["g"]: (r["a"], r["b"]) for r in grouped_quantiles(d, "x", ["g"], {"a": 0.1, "b": 0.9}).collect()}
    groups = [None if k % 7 == 0 else k % 3 for k in range(len(x))]
    for g in (None, 0, 1, 2):
        assert got[g] == pytest.approx(np.quantile(x[[h == g for h in groups]], [0.1, 0.9]).tolist())


def test_bootstrap_far_from_zero(spark):
    d = spark.createDataFrame([(1e9 + 0.1 * (k % 2), k) for k in range(4000)], "x double, k long")
    got = samples.poisson_bootstrap(d, "x", 30, seed=1, key="k").toPandas()
    again = samples.poisson_bootstrap(d.repartition(9), "x", 30, seed=1, key="k").toPandas()
    assert len(got) == 30 and got.sd.between(0.0499, 0.0501).all() and abs(got.n.mean() - 4000) < 60
    assert np.allclose(got.sort_values("replicate")["mean"], again.sort_values("replicate")["mean"])


def test_coverage_and_delivery(spark):
    chunks = spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("a", 20, 30), ("a", 22, 25), ("a", 20, 30), ("b", 3, 4)], "source string, row_start long, row_stop long")
    assert sorted(map(tuple, evidence.coverage(chunks).collect())) == [("a", 0, 9), ("a", 20, 30), ("b", 3, 4)]
    assert sorted(map(tuple, streams.delivery_faults(chunks).collect())) == [("a", 20, "DUPLICATE"), ("a", 20, "GAP"), ("a", 22, "OVERLAP"), ("b", 3, "GAP")]
    assert evidence.coverage(chunks.limit(0)).count() == 0
    kept, mark = evidence.replay(chunks)
    evidence.verify(kept.repartition(2), mark)
    with pytest.raises(ValueError, match="DIGEST_MISMATCH"):
        evidence.verify(kept.limit(2), mark)
    with pytest.raises(ValueError, match="LENGTH_MISMATCH"):
        evidence.zip_weights(spark.createDataFrame([(0, 1.0), (1, 2.0)], "row int, v double"), spark.createDataFrame([(0, 1.0)], "row int, w double"))
    assert evidence.digest("t", "ab", "c") != evidence.digest("t", "a", "bc") and evidence.parameter_fingerprint("weibull_min", (1, 2)) == evidence.parameter_fingerprint("Weibull", (1.0, 2.0))


def test_refusals_and_choice(spark):
    d = spark.createDataFrame([(float(k),) for k in range(50)], "x double")
    with pytest.raises(gof.RefitRefused):
        assess.hypothesis_test(d, "x", lambda r, n: r.random(n), np.mean, 3, most_rows=20)
    assert [r["family"] for r in samples.suggest(d.filter("x > 0"), "x").orderBy("place").collect()] == ["normal", "lognormal", "gamma", "weibull", "exponential"]
    assert [r["family"] for r in samples.suggest(d, "x").collect()] == ["normal"]
    p = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", None)], "family string, p_value double")
    assert assess.best_by_p(p).first()["family"] == "a" and assess.calibration(p, 0.6).first()["rate"] == 1.0
    x = 5 + 2 * np.log(1 / (1 - np.linspace(0.01, 0.99, 400)) - 1)
    m, s = gof._FAST["logistic"](x)
    t = np.tanh((x - m) / s / 2)
    assert abs(t.sum()) < 1e-8 and abs(((x - m) / s * t).sum() - len(x)) < 1e-6


@pytest.mark.parametrize("name,params", [("exponential", (0.3,)), ("weibull", (1.4, 3.0)), ("gumbel", (2.0, 1.5)), ("normal", (2.5, 1.7)), ("lognormal", (0.8, 0.9)), ("gamma", (2.2, 1.3))])
def test_derivatives_equal_differences(spark, name, params):
    from quernel.functions.families import family
    from quernel.operators import score
    from quernel.sources.observations import observations

    rng = np.random.default_rng(5)
    rows = [(float(v), bool(c) or name == "gamma", float(w)) for v, c, w in zip(rng.gamma(2, 1.5, 60) + 0.05, rng.random(60) < 0.6, rng.integers(0, 3, 60), strict=True)]
    o = observations(spark.createDataFrame(rows, "x double, seen boolean, w double"), "x", event="seen", weight="w").persist()
    value, g, h = score.derivatives(o, name, params)
    positive = family(name).positive
    move = lambda u: tuple(math.exp(v) if q else v for v, q in zip(u, positive, strict=True))
    u, e = np.array([math.log(v) if q else v for v, q in zip(params, positive, strict=True)]), 1e-3
    k = len(u)
    points = [u] + [u + s * e * np.eye(k)[i] for i in range(k) for s in (1, -1)] + [u + e * (s * np.eye(k)[0] + t * np.eye(k)[1]) for s in (1, -1) for t in (1, -1) if k > 1]
    _, ll = fit.log_likelihoods(o, name, [move(p) for p in points])
    assert value == pytest.approx(ll[0], rel=1e-10)
    for i in range(k):
        assert g[i] == pytest.approx((ll[1 + 2 * i] - ll[2 + 2 * i]) / (2 * e), rel=1e-4, abs=1e-4)
        assert h[i, i] == pytest.approx((ll[1 + 2 * i] - 2 * ll[0] + ll[2 + 2 * i]) / e**2, rel=1e-3, abs=1e-3)
    if k > 1:
        pp, pm, mp, mm = ll[1 + 2 * k :]
        assert h[0, 1] == h[1, 0] == pytest.approx((pp - pm - mp + mm) / (4 * e * e), rel=1e-3, abs=1e-3)
    o.unpersist()


def test_stream_of_draws(spark, tmp_path):
    from quernel.streaming import source

    source.register(spark)
    s = spark.readStream.format("quernel_draws").option("family", "exponential").option("params", "[0.5]").option("rows", 200).option("blocks", 6).load()
    q = s.writeStream.format("memory").queryName("draws").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(40):
            q.processAllAvailable()
            if spark.table("draws").count() >= 1200:
                break
    finally:
        q.stop()
    rows = spark.table("draws").toPandas().sort_values("row")
    assert rows.row.tolist() == list(range(1200)) and abs(rows["value"].mean() - 2) < 0.3


def test_report_languages():
    f = {"family": "weibull", "code": "OK", "n": 3, "params": {"shape": 1.5}}
    assert "dir='rtl'" in assess.report_html(f, language="fa") and "Werte" in assess.report_html(f, language="de") and "Values" in assess.report_html(f)

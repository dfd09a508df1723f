"""Whole procedures."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from quernel.functions.families import family
from quernel.operators import assess, fit, gof, replicates, uncertainty
from quernel.sources import tables


def frame(spark, x):
    return spark.createDataFrame([(float(v),) for v in x], "x double")


def test_one_door(spark):
    df = frame(spark, family("weibull").quantile((np.arange(300) + 0.5) / 300, 1.5, 10.0)).withColumn("w", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(2.0))
    for name in ("weibull", "exponential", "gamma", "gumbel", "lognormal"):
        a, b = assess.fit_family(df, "x", name), assess.fit_family(df, "x", name, weight="w")
        assert a["code"] == b["code"] == "OK" and np.allclose(list(a["params"].values()), list(b["params"].values()), rtol=1e-3)
        assert abs(b["loglik"] - 2 * a["loglik"]) < 1e-2
    assert assess.fit_family(df, "x", "gamma", method="moments")["params"]["shape"] > 0


def test_p_values_fall():
    for p, top in ((assess.ad_p_value, 400.0), (assess.cvm_p_value, 60.0)):
        v = [p(x, 100) for x in np.linspace(0.001, top, 4000)]
        assert max(np.diff(v)) < 0.02 and v[-1] < 1e-3 and v[0] > 0.99


def test_all_tests_and_assessment(spark):
    x = np.random.default_rng(5).exponential(4, 150)
    got = {r["statistic"]: r for r in assess.all_tests(frame(spark, x), "x", "exponential", (0.25,)).collect()}
    assert set(got) == {"ks", "ad", "cvm", "chi_square"} and all(0 <= r["p_value"] <= 1 for r in got.values())
    assert abs(got["ks"]["value"] - gof.small_statistics(x, "exponential", (0.25,))[0]) < 1e-12
    rows, best = assess.assess(frame(spark, x), "x", ["normal", "exponential"], 30)
    assert best["family"] == "exponential" and {r["family"] for r in rows.collect()} == {"normal", "exponential"}
    low, none = assess.assess(frame(spark, -x), "x", ["exponential"], 5)
    assert low.first()["code"] == "INVALID_SUPPORT" and none["code"] == "NONE_ADEQUATE"


@pytest.mark.parametrize("name", ["weibull", "gumbel"])
def test_profile_at_scale(spark, name):
    x = np.random.default_rng(2).weibull(1.4, 250) * 3
    df = frame(spark, x)
    f = fit.fit_weibull(df, "x") if name == "weibull" else fit.fit_gumbel(df, "x")
    got = assess.profile_shape(df, "x", f)

    def loglik(b):
        k = family(name)
        if name == "weibull":
            return float(k.logpdf(x, b, np.mean(x**b) ** (1 / b)).sum())
        return float(k.logpdf(x, -b * np.log(np.mean(np.exp(-x / b))), b).sum())

    want = uncertainty.profile(loglik, f["shape"] if name == "weibull" else f["scale"])
    assert np.allclose([got["lower"], got["upper"]], [want["lower"], want["upper"]], rtol=1e-4) and got["passes"] <= 10


def test_hypothesis(spark):
    df = frame(spark, np.random.default_rng(1).normal(1.0, 1, 80))
    r = assess.hypothesis_test(df, "x", lambda rng, n: rng.normal(0, 1, n), lambda v: v.mean(), 100)
    assert r["p_value"] < 0.02


def test_tables(spark):
    t = pa.table({"a": [1.0, 2.0], "b": [3, 4]})
    assert tables.from_arrow(spark, t, "b").agg({"x": "sum"}).first()[0] == 7.0
    assert tables.from_arrow(spark, t.to_reader(), "a").count() == 2
    assert tables.from_duckdb(spark, duckdb.connect(), "select 5.0 as v union all select 6.0", "v").agg({"x": "max"}).first()[0] == 6.0
    assert tables.from_array(spark, [[1, 2], [3, 4]], 2).count() == 4
    with pytest.raises(ValueError):
        tables.from_arrow(spark, t, "c")


def test_report_and_digest(spark):
    assert "<th scope='row'>rate</th>" in assess.report_html({"family": "exponential", "params": {"rate": 0.5}})
    assert assess.environment_digest(spark) == assess.environment_digest(spark)


@pytest.mark.parametrize("name", ["exponential", "normal", "lognormal", "weibull", "gumbel", "gamma", "wald", "pareto", "rayleigh", "uniform"])
def test_replicates_in_blocks(spark, monkeypatch, name):
    """Blocks give the statistics of the whole replicate, refitted by the plain formulas."""
    monkeypatch.setattr(replicates, "BLOCK", 3000)
    p = {"exponential": (0.1,), "weibull": (1.3, 20.0), "gumbel": (3.0, 2.0), "gamma": (2.0, 3.0), "wald": (2.0, 5.0), "pareto": (2.5, 1.0), "rayleigh": (4.0,), "uniform": (1.0, 3.0)}.get(name, (1.0, 0.7))
    n = 10_000 if name not in ("gamma", "wald") else 4000
    got = {r["r"]: r for r in replicates.statistics(spark, name, p, n, 2, 7).collect()}
    blocks = -(-n // 3000)
    for r in range(2):
        c = np.random.default_rng([7, r]).multinomial(n, np.full(blocks, 1 / blocks))
        x = np.concatenate([replicates._drawn(name, p, 7, blocks, r, b, k) for b, k in enumerate(c)])
        want = gof.small_statistics(x, name, gof._FAST[name](x))
        assert len(x) == n and np.allclose([got[r][k] for k in ("ks", "ad", "cvm")], want, rtol=1e-6, atol=1e-8)


def test_monte_carlo_beyond_whole_replicates(spark):
    df = frame(spark, np.random.default_rng(4).exponential(5.0, 3000))
    few, many = ({r["statistic"]: r for r in gof.monte_carlo(df, "x", "exponential", 60, seed=2, whole=w).collect()} for w in (5000, 1000))
    for k in ("ks", "ad", "cvm"):
        assert abs(few[k]["value"] - many[k]["value"]) < 1e-9 and abs(few[k]["p_value"] - many[k]["p_value"]) < 0.25 and many[k]["failures"] == 0


def test_families_are_weighed_beyond_whole_replicates(spark):
    """Families of a sample larger than a replicate that one task draws, and the gate on them."""
    df = frame(spark, np.random.default_rng(6).exponential(5.0, 400))
    rows, best = assess.assess(df, "x", ["exponential", "normal"], 30, whole=100)
    got = {r["family"]: r["p_value"] for r in rows.collect()}
    assert got["exponential"] > 0.05 > got["normal"] and best["family"] == "exponential"


def test_families_are_weighed_where_workers_lack_the_package(tmp_path, sf):
    """A session started elsewhere, whose workers find this package neither in their folder nor on their path."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.insert(0, {str(root)!r})
from quernel.operators import assess
d = s.read.parquet("{sf}/events.parquet").filter("value > 0")
for whole in (100_000, 100):
    rows, _ = assess.assess(d, "value", ["exponential", "lognormal"], 4, seed=1, whole=whole)
    print("weighed", rows.filter("code = 'OK' and p_value is not null").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.split("\n").count("weighed 2") == 2, out.stderr[-2000:]

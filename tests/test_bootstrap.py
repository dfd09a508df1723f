"""The bag of little bootstraps."""

import numpy as np
from quernel.operators import bootstrap
from quernel.operators.ranking import quantiles


def test_median_of_a_large_table(spark):
    df = spark.range(200_000).selectExpr("id", "-ln(1 - (pmod(xxhash64(id), 1000003) + 0.5) / 1000003) as x")
    (median,) = quantiles(df, "x", (0.5,))
    r = bootstrap.interval(bootstrap.little_bootstraps(df, "x", bootstrap.weighted_quantile(0.5), resamples=100, count=8, size=4000, key="id"), median)
    # The median's error is 1 / (2 f sqrt(n)), with f = 1 / 2 there.
    assert r["bags"] == 8 and abs(r["se"] * np.sqrt(200_000) - 1) < 0.25 and r["lower"] < median < r["upper"]


def test_coverage(spark):
    """Intervals of a trimmed ratio hold the truth about as often as they say."""
    r, hits, times = np.random.default_rng(1), 0, 120
    draws = r.exponential(2.0, (times, 900))

    def ratio(x, w):
        return float((w * x).sum() / w.sum())

    for t, x in enumerate(draws):
        parts = np.array_split(r.permutation(x), 3)
        low, high = [], []
        for part in parts:
            values = [ratio(part, r.multinomial(len(x), np.full(len(part), 1 / len(part)))) - part.mean() for _ in range(100)]
            low.append(np.quantile(values, 0.025))
            high.append(np.quantile(values, 0.975))
        hits += x.mean() - np.mean(high) < 2.0 < x.mean() - np.mean(low)
    assert 0.9 <= hits / times <= 0.99
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(draws[0])], "id long, x double")
    out = bootstrap.little_bootstraps(df, ["x"], ratio, resamples=100, count=3, size=300, key="id")
    got = bootstrap.interval(out, float(draws[0].mean()))
    assert got["bags"] == 3 and abs(got["se"] - draws[0].std() / 30) < 0.02
    assert sum(b["rows"] for b in out.select("bag", "rows").distinct().collect()) == 900


def test_two_columns_nulls_and_none(spark):
    df = spark.createDataFrame([(k, float(k % 7), float(k % 5) if k % 10 else None) for k in range(400)], "id long, x double, y double")
    slope = lambda x, y, w: float(np.average((x - np.average(x, weights=w)) * y, weights=w))
    out = bootstrap.little_bootstraps(df, ["x", "y"], slope, resamples=20, count=2, size=500, key="id")
    assert out.count() == 40 and sum(b["rows"] for b in out.select("bag", "rows").distinct().collect()) == 360
    assert bootstrap.interval(bootstrap.little_bootstraps(df.limit(0), ["x", "y"], slope, resamples=5), 1.0)["reason"] == "NO_DATA"

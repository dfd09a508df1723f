"""Each catalogued query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from quernel.operators import fit, score
from quernel.plans import catalog, catalog_evidence, catalog_fits  # noqa: F401 - these add their queries

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        elif df[c].dtype == object and df[c].map(type).isin([str, type(None)]).all():
            pass
        elif df[c].dtype != bool:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, sf, duck, name):
    got, want = plain(catalog.QUERIES[name](spark, sf).toPandas()), plain(duck.sql(catalog.ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=2e-6)


@pytest.mark.parametrize("name", ["normal", "gamma"])
def test_functions_of_every_event(spark, sf, name):
    """Far values too, against closed forms."""
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value").collect()
    got = {r["event_id"]: r for r in catalog.QUERIES[f"functions_{name}_whole"](spark, sf).collect()}
    assert len(got) == sum(name == "normal" or r["value"] > 0 for r in rows) and max(r["value"] for r in rows) > 200
    for i, v in rows:
        if i in got and name == "normal":
            want = 0.5 * math.erfc((50 - v) / 50 / math.sqrt(2)), -0.5 * ((v - 50) / 50) ** 2 - math.log(50) - 0.5 * math.log(2 * math.pi)
        elif i in got:
            y = v / 20
            want = math.erf(math.sqrt(y)) - math.exp(-y) * (math.sqrt(y) / math.gamma(1.5) + y**1.5 / math.gamma(2.5)), 1.5 * math.log(y) - y - math.lgamma(2.5) - math.log(20)
        else:
            continue
        assert abs(got[i]["cdf"] - want[0]) < 2e-8 and abs(got[i]["logpdf"] - want[1]) < 2e-8


def test_monte_carlo_takes_the_whole_table(spark, sf):
    x = np.sort([r[0] for r in spark.read.parquet(f"{sf}/events.parquet").select("value").collect()])
    p, n = 1 - np.exp(-x / x.mean()), len(x)
    ks = max((np.arange(1, n + 1) / n - p).max(), (p - np.arange(n) / n).max())
    got = {r["statistic"]: r["value"] for r in catalog.QUERIES["monte_carlo_gof"](spark, sf).collect()}
    assert abs(got["ks"] - ks) < 1e-7


def test_gate_on_fitted_families(spark, sf):
    rows = catalog.QUERIES["assess_families"](spark, sf).collect()
    good = sorted((r["aic"], r["family"]) for r in rows if r["p_value"] is not None and r["p_value"] >= 0.05)
    got = catalog.QUERIES["adequacy_gate_fitted"](spark, sf).first()
    assert len(rows) == 4 and tuple(got) == (("OK", good[0][1], good[0][0]) if good else ("NONE_ADEQUATE", None, None))


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_newton_families_pass_over_distinct_values(spark, sf, monkeypatch):
    """Values repeat, so passes go over each once with its weight; n is that of all rows."""
    seen, real = [], fit.log_likelihoods
    monkeypatch.setattr(fit, "log_likelihoods", lambda obs, *more: (seen.append(obs), real(obs, *more))[1])
    got = {r["family"]: r for r in catalog.QUERIES["fit_newton_families"](spark, sf).collect()}
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    assert got["logistic"]["n"] == got["f"]["n"] == events and got["beta"]["n"] > 1000
    assert max(o.count() for o in (seen[0], seen[-1])) <= 997


def test_censored_newton_passes_over_distinct_values(spark, sf, monkeypatch, tmp_path):
    """Five copies of the events give passes over as many rows as one; n is that of all rows, and parameters stay."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.crossJoin(spark.range(5)).drop("id").write.parquet(f"{tmp_path}/events.parquet")
    seen, real = [], score.derivatives
    monkeypatch.setattr(score, "derivatives", lambda obs, *more: (seen.append(obs), real(obs, *more))[1])
    one, five = ({r["family"]: r for r in catalog.QUERIES["fit_newton_censored"](spark, d).collect()} for d in (sf, str(tmp_path)))
    rows = events.filter("value > 0")
    assert len(five) == 6 and {r["n"] for r in five.values()} == {5 * rows.count()}
    assert seen[-1].count() <= rows.count()
    for name, r in five.items():
        assert r["code"] == "OK" and (r["p1"], r["p2"]) == (one[name]["p1"], one[name]["p2"])
        assert abs(r["loglik"] - 5 * one[name]["loglik"]) < 0.5

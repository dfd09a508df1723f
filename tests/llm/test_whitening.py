"""Operator 12: whitening."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from quernel.llm import queries, whitening


def brute(rows, most=4):
    """Rows, n, and what a plain calculation with fractions and a double eigen-solve gives."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in good]
    sizes = Counter(len(x) for x in {x for _, x in xs} if x)
    d = max(sizes, key=lambda k: (sizes[k], k))
    xs = [(i, x) for i, x in xs if len(x) == d]
    fit = sorted({x for _, x in xs})
    n, s = len(fit), [sum(x[j] for x in fit) for j in range(d)]
    v = np.array([[float(sum((Fraction(x[i]) - Fraction(s[i], n)) * (Fraction(x[j]) - Fraction(s[j], n)) for x in fit) / n) for j in range(d)] for i in range(d)])
    values, q = np.linalg.eigh(v)
    q, values = q[:, ::-1][:, :most], values[::-1][:most]
    mean = np.array([float(Fraction(t, n)) for t in s])
    return [(i, sum((n * a - b) ** 2 for a, b in zip(x, s)), (np.array(x) - mean) @ q / np.sqrt(values)) for i, x in xs], n, values / np.trace(v), v


def compare(spark, rows, atol=1e-9):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = whitening.whiten(df).collect()
    want, n, share, _ = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    assert len(got) == len(want) * len(share) and {r["n"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    signs = None
    for i, deviation, w in want:
        own = by[i]
        assert all(own[k + 1]["deviation"] == deviation for k in range(len(share)))
        assert np.allclose([own[k + 1]["explained"] for k in range(len(share))], share, rtol=1e-9)
        mine = np.array([own[k + 1]["whitened"] for k in range(len(share))])
        if signs is None and (np.abs(w) > 1e-3).all():
            signs = np.sign(mine * w)
        if signs is not None:
            assert np.allclose(mine, signs * w, atol=atol)
    assert signs is not None and got[0]["identity_error"] < 1e-12


def test_equals_brute_force(spark):
    r = np.random.default_rng(1)
    z = r.normal(size=(120, 7)) * [5, 3, 2, 1.5, 1, 0.5, 0.2] + 100
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(z)]
    rows += [(200 + k, rows[0][1]) for k in range(60)]  # a third of all rows are one vector
    rows += [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0]), (302, [float("nan")] * 7), (303, [float("inf")] * 7), (304, []), (305, [1.0, 2.0])]
    compare(spark, rows)


def test_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.QUERIES["op12_whitened"](spark, sf).collect()
    want, n, share, _ = brute(rows)
    assert len(got) == 4 * len(want) and {r["n"] for r in got} == {n} and {r["component"] for r in got} == {1, 2, 3, 4}
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(i, x) for i, x, _ in want}
    plain = {(i, k + 1): w[k] for i, _, w in want for k in range(4)}
    for k in range(1, 5):
        mine = np.array([(r["whitened"], plain[r["vec_id"], k]) for r in got if r["component"] == k])
        assert np.allclose(np.abs(mine[:, 0]), np.abs(mine[:, 1]), atol=1e-9)
    assert np.allclose(sorted({r["explained"] for r in got}), sorted(share), rtol=1e-9) and got[0]["identity_error"] < 1e-10


def test_few_dimensions_and_none(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [3.0]), (3, [3.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in whitening.whiten(df).collect()}
    assert {abs(r["whitened"]) for r in got.values()} == {1.0} and {r["deviation"] for r in got.values()} == {512**2} and got[1]["explained"] == 1.0
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.filter("false")).dtypes == whitening.whiten(df).dtypes
    same = whitening.whiten(spark.createDataFrame([(1, [2.0, 2.0])] * 3, "vec_id long, embedding array<float>")).collect()
    assert len(same) == 6 and {(r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in same} == {(1, 0, None, None)}


def test_extreme_entries_and_extra_columns(spark):
    rows = [(k, [1e300 * (k % 3 - 1), float(k)], "w") for k in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string")
    out = whitening.transform(df, whitening.fit(df))
    assert out.columns == ["vec_id", "embedding", "whitened", "deviation"] and out.count() == 9
    assert out.filter("deviation is null").count() == 6  # of the rest the exact sums cancel


def test_sums_are_double_double():
    """A mean of 10^8 and a spread of 1: plain sums of products would keep no digit of the covariance."""
    r = np.random.default_rng(2)
    x = r.integers(-2, 3, (5000, 5)) + 10**14
    s = [int(v) for v in x.sum(axis=0)]
    model = whitening.Whitening(5, len(x), s)
    parts = [whitening.Products(5) for _ in range(3)]
    for k, p in enumerate(parts):
        p.add(*model.centred(x[k::3]))
    total = whitening.Products.unpacked(parts[0].packed(), 5)
    for p in parts[1:]:
        total.merge(p)
    for i in range(5):
        for j in range(5):
            exact = sum(Fraction(int(a) * len(x) - s[i], len(x)) * Fraction(int(b) * len(x) - s[j], len(x)) for a, b in zip(x[:, i], x[:, j]))
            mine = Fraction(float(total.outer[0][i, j])) + Fraction(float(total.outer[1][i, j]))
            assert abs(mine - exact) <= abs(Fraction(s[i], 1)) * Fraction(1, 10**26) + abs(exact) * Fraction(1, 2**80)


def test_close_eigenvalues():
    """Vectors of values that differ by a millionth are right to the last bits."""
    r = np.random.default_rng(4)
    q = np.linalg.qr(r.normal(size=(8, 8)))[0]
    values = np.array([1, 1 - 1e-6, 1 - 2e-6, 0.5, 0.4, 0.3, 0.2, 0.1])
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    got_values, got = np.linalg.eigh(v)
    order = np.argsort(-got_values)
    for k in range(3):
        (high, low), value = whitening.corrected((v, np.zeros_like(v)), got_values[order], got[:, order], k)
        exact = [Fraction(float(a)) + Fraction(float(b)) for a, b in zip(high, low)]
        image = [sum(Fraction(float(v[i, j])) * exact[j] for j in range(8)) for i in range(8)]
        best = sum(a * b for a, b in zip(exact, image)) / sum(a * a for a in exact)
        assert max(abs(float(a - best * b)) for a, b in zip(image, exact)) < 1e-23
        assert abs(float(sum(a * a for a in exact) - 1)) < 1e-15 and abs(value - float(best)) < 1e-15


@pytest.mark.parametrize("fan", [2, 5])
def test_merge_tree(spark, monkeypatch, fan):
    monkeypatch.setattr(whitening, "FAN", fan)
    r = np.random.default_rng(6)
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(r.normal(size=(400, 3)))], "vec_id long, embedding array<double>").repartition(13)
    one, model = whitening.fit(df), brute([(x["vec_id"], x["embedding"]) for x in df.collect()])[3]
    assert np.allclose(sorted(one.values), np.linalg.eigvalsh(model), rtol=1e-12)

"""Sources that executors read in slices."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from quernel.operators import fit
from quernel.sources import readers


def sums(df):
    r = df.selectExpr("count(*) c", "count(x) n", "sum(x) s", "max(x) m").first()
    return r["c"], r["n"], r["s"], r["m"]


def test_npy(spark, tmp_path):
    x = np.arange(1000, dtype=np.int32)
    np.save(tmp_path / "a b.npy", x)
    np.save(tmp_path / "c.npy", np.asfortranarray(x.reshape(10, 100).astype(np.float32)))
    df = readers.read_npy(spark, [tmp_path / "a b.npy", tmp_path / "c.npy"], rows_each=300)
    assert sums(df) == (2000, 2000, 2 * x.sum(), 999) and df.rdd.getNumPartitions() == 8
    assert sums(readers.read_npy(spark, str(tmp_path / "*.npy"))) == (2000, 2000, 2 * x.sum(), 999)
    np.save(tmp_path / "none.npy", x[:0])
    assert readers.read_npy(spark, tmp_path / "none.npy").count() == 0
    np.save(tmp_path / "text.npy", np.array(["a"]))
    with pytest.raises(Exception, match="not numbers"):
        readers.read_npy(spark, tmp_path / "text.npy").count()
    assert fit.fit_closed(df.filter("x > 0"), "x", ["exponential"]).first()["n"] == 1998


def test_arrow(spark, tmp_path):
    t = pa.table({"k": pa.array([1, None, 3, 4, 5] * 200), "v": ["x"] * 1000})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t, max_chunksize=100)
    df = readers.read_arrow(spark, tmp_path / "t.arrow", "k", rows_each=250)
    assert sums(df) == (1000, 800, 2600, 5) and df.rdd.getNumPartitions() == 5
    for column, message in (("v", "not numbers"), ("w", "exactly once")):
        with pytest.raises(Exception, match=message):
            readers.read_arrow(spark, tmp_path / "t.arrow", column).count()


def test_duckdb(spark, sf, tmp_path):
    with duckdb.connect(str(tmp_path / "d.db")) as c:
        c.sql('create table "odd ""name" as select i as "a ""b", i % 7 = 0 as gone from range(1000) t(i)')
        c.sql('delete from "odd ""name" where gone')
        want = c.sql('select count(*), sum("a ""b"), max("a ""b") from "odd ""name"').fetchall()[0]
    df = readers.read_duckdb(spark, tmp_path / "d.db", 'a "b', 'odd "name', rows_each=90)
    n, _, s, m = sums(df)
    assert (n, s, m) == want
    file = readers.read_duckdb(spark, f"{sf}/events.parquet", "value", rows_each=130)
    plain = spark.read.parquet(f"{sf}/events.parquet").selectExpr("value as x")
    assert sums(file)[:2] == sums(plain)[:2] and sums(file)[2] == pytest.approx(sums(plain)[2])

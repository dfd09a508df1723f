"""Stores belong to one job, names of files may hold anything, and a fit never answers from sums of something else."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from quernel.operators import evidence, scale
from quernel.sources import lifetime_csv, partitions
from quernel.sources.partitions import ResumeRefused

FOLDERS = ["plain", "a b", "50% of", "über", "x[1]", "y{2}", "z+&=#"]


def numbers(spark, n=1000, start=0):
    return spark.range(start, start + n).select((F.col("id") * 0.1 + 0.05).alias("x"), (1000 - F.col("id") * 0.5).alias("y"))


@pytest.mark.parametrize("name", FOLDERS)
def test_any_folder_name(spark, tmp_path, name):
    safe = evidence.glob_safe(str(tmp_path / name))
    numbers(spark).repartition(4).write.parquet(str(tmp_path / name))
    got = scale.fit_incremental(spark, safe, "x", "exponential", str(tmp_path / "store"))
    assert (got["code"], got["n"], got["files"]) == ("OK", 1000, {"added": 4}) and abs(got["params"]["rate"] - 1 / 50) < 1e-9
    again = scale.fit_incremental(spark, safe, "x", "exponential", str(tmp_path / "store"))
    assert again["files"] == {"kept": 4} and again["params"] == got["params"]
    rows = spark.range(10).select(F.concat(F.col("id") + 1, F.lit(",1")).alias("v"))
    csv = tmp_path / f"{name} csv"
    csv.mkdir()
    (csv / "one.csv").write_text("time,event_observed\n" + "".join(f"{r['v']}\n" for r in rows.collect()))
    out = lifetime_csv.checkpointed_fit(spark, evidence.glob_safe(str(csv)), str(tmp_path / "csvstore"), "s")
    assert (out["code"], out["n"], out["events"], out["exposure"]) == ("COMPLETE", 10, 10, 55.0)


def test_fit_of_another_filter_is_refused(spark, tmp_path):
    numbers(spark).write.parquet(str(tmp_path / "d"))
    df, store = spark.read.parquet(str(tmp_path / "d")), str(tmp_path / "s")
    first = scale.fit(df.filter("x > 0"), "x", "exponential", store=store)
    assert scale.fit(df.filter("x > 0"), "x", "exponential", store=store, resume=True)["reused"] == 1
    for other, column in ((df.filter("x > 50"), "x"), (df.filter("x > 0").select((F.col("x") * 2).alias("x")), "x"), (df.filter("x > 0"), "y")):
        with pytest.raises(ResumeRefused, match="JOB_CHANGED"):
            scale.fit(other, column, "exponential", store=store, resume=True)
    assert first["n"] == 1000
    numbers(spark, 10, 5000).write.mode("append").parquet(str(tmp_path / "d"))
    with pytest.raises(ResumeRefused, match="JOB_CHANGED"):
        scale.fit(spark.read.parquet(str(tmp_path / "d")).filter("x > 0"), "x", "exponential", store=store, resume=True)


def test_rows_in_memory_are_told_apart(spark, tmp_path):
    a, b = (spark.createDataFrame([(v,), (2 * v,)], "x double") for v in (1.0, 10.0))
    scale.fit(a, "x", "exponential", store=str(tmp_path / "s"))
    assert scale.fit(a, "x", "exponential", store=str(tmp_path / "s"), resume=True)["reused"] == 1
    with pytest.raises(ResumeRefused, match="JOB_CHANGED"):
        scale.fit(b, "x", "exponential", store=str(tmp_path / "s"), resume=True)


def test_incremental_store_belongs_to_its_column(spark, tmp_path):
    numbers(spark).write.parquet(str(tmp_path / "d"))
    scale.fit_incremental(spark, str(tmp_path / "d"), "x", "exponential", str(tmp_path / "s"))
    with pytest.raises(ResumeRefused, match="JOB_CHANGED"):
        scale.fit_incremental(spark, str(tmp_path / "d"), "y", "exponential", str(tmp_path / "s"))


def test_incremental_codes_are_those_of_a_fit(spark, tmp_path):
    cases = {"negative": [-1.0, 2.0, 3.0], "constant": [4.0, 4.0], "zeros": [0.0, 0.0], "sound": [1.0, 2.0, 5.0], "empty": []}
    for name, values in cases.items():
        spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        for family in ("exponential", "normal", "lognormal", "gamma"):
            one, more = scale.fit(df, "x", family), scale.fit_incremental(spark, str(tmp_path / name), "x", family, str(tmp_path / f"s{name}"))
            assert (one["code"], one["n"]) == (more["code"], more["n"]), (name, family)
            assert one["params"] == pytest.approx(more["params"], rel=1e-12) and (one["loglik"] is None or one["loglik"] == pytest.approx(more["loglik"], rel=1e-9))


def test_a_file_without_rows_is_kept(spark, tmp_path):
    numbers(spark, 5).coalesce(1).write.parquet(str(tmp_path / "d/a"))
    numbers(spark, 0).coalesce(1).write.parquet(str(tmp_path / "d/b"))
    _, seen = partitions.refreshed(spark, str(tmp_path / "d"), "x", str(tmp_path / "s"))
    _, again = partitions.refreshed(spark, str(tmp_path / "d"), "x", str(tmp_path / "s"))
    assert set(again) == {"kept"} and again["kept"] == seen["added"]


def test_unions_and_aggregates_over_files_are_fitted(spark, tmp_path):
    numbers(spark).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    assert scale.fit(df.union(df), "x", "exponential")["n"] == 2000
    grouped = df.groupBy((F.col("x") % 10).alias("k")).agg(F.sum("x").alias("x"))
    assert scale.fit(grouped, "x", "normal", store=str(tmp_path / "s"))["code"] == "OK"
    assert scale.fit(grouped, "x", "normal", store=str(tmp_path / "s"), resume=True)["reused"] == 1


def test_a_fit_scans_once(spark, tmp_path):
    """The ledger's passes are the jobs that read data."""
    numbers(spark).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    spark.sparkContext.setJobGroup("fit", "fit")
    r = scale.fit(df, "x", "exponential")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("fit")
    spark.sparkContext._jsc.clearJobGroup()
    assert r["passes"] == 1 and len(jobs) <= 2  # partial sums and their total


def test_zip_takes_null_entries(spark):
    a = spark.createDataFrame([(0, 1.0), (1, None)], "row long, v double")
    b = spark.createDataFrame([(0, None), (1, 2.0)], "row long, w double")
    assert sorted(map(tuple, evidence.zip_weights(a, b).collect())) == [(0, 1.0, None), (1, None, 2.0)]
    with pytest.raises(ValueError, match="LENGTH_MISMATCH: 1"):
        evidence.zip_weights(a, b.filter("row = 0"))


GOOD = "time,event_observed\n1.5,1\n2e1,0\n0.25,1\r\n3,1\n"
BAD = {
    "HEADER": "time,event\n1,1\n", "FIELDS": GOOD + "1,1,1\n", "TIME": GOOD + " 1,1\n", "EVENT": GOOD + "1,2\n", "TIME_RANGE": GOOD + "1e999,1\n", "BLANK": "time,event_observed\n1,1\n\n2,1\n",
}


def test_csv_fit_in_one_pass(spark, tmp_path):
    (tmp_path / "good").mkdir()
    (tmp_path / "good/a.csv").write_bytes(GOOD.encode())
    (tmp_path / "good/b.csv").write_bytes(("﻿" + GOOD).encode())
    r = lifetime_csv.fit(spark, str(tmp_path / "good"))
    assert (r["code"], r["n"], r["events"], r["exposure"]) == ("OK", 8, 6, 49.5) and r["rate"] == 6 / 49.5
    assert sorted(map(tuple, lifetime_csv.read_lifetimes(spark, str(tmp_path / "good")).collect())) == sorted([(1.5, True), (20.0, False), (0.25, True), (3.0, True)] * 2)
    for code, text in BAD.items():
        (tmp_path / code).mkdir()
        (tmp_path / code / "x.csv").write_bytes(text.encode())
        assert lifetime_csv.fit(spark, str(tmp_path / code)) == {"code": "FORMAT_MISMATCH", "broken": {code: 1}} or code == "HEADER"
        assert lifetime_csv.fit(spark, str(tmp_path / code))["broken"][code] == 1
        out = lifetime_csv.checkpointed_fit(spark, str(tmp_path / code), str(tmp_path / f"s{code}"), "s")
        assert out["code"] == "FORMAT_MISMATCH" and out["broken"][code] == 1 and out["n"] == 0


@pytest.mark.parametrize("line", ["1,1 ", "1,1 ", "01,1", "1.,1", "+1,1", "1,1\r\r", "1,١", "1e,1", "NaN,1", "1_0,1", "0.0e-400,1", "1e-400,1", "9" * 310 + ",1", "0." + "0" * 330 + "1,1"])
def test_unusual_lines(spark, tmp_path, line):
    """What the pattern of plain lines passes, the rules one by one pass too."""
    (tmp_path / "x.csv").write_bytes(f"time,event_observed\n{line}\n".encode())
    sound = line in ("0.0e-400,1",)
    assert (lifetime_csv.fit(spark, str(tmp_path / "x.csv"))["code"] != "FORMAT_MISMATCH") == sound


def test_csv_steps_go_on(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for k in range(5):
        (d / f"{k}.csv").write_text(f"time,event_observed\n{k + 1},1\n")
    calls = []
    first = lifetime_csv.checkpointed_fit(spark, str(d), str(tmp_path / "s"), "s", 2, lambda: len(calls) > 0 or bool(calls.append(1)))
    assert first["code"] == "CANCELLED" and first["files_done"] == 2
    assert lifetime_csv.checkpointed_fit(spark, str(d), str(tmp_path / "s"), "other")["code"] == "SOURCE_MISMATCH"
    out = lifetime_csv.checkpointed_fit(spark, str(d), str(tmp_path / "s"), "s", 2)
    assert (out["code"], out["n"], out["exposure"], out["files_done"]) == ("COMPLETE", 5, 15.0, 5)
    (d / "0.csv").write_text("time,event_observed\n9,1\n10,1\n")
    assert lifetime_csv.checkpointed_fit(spark, str(d), str(tmp_path / "s"), "s", 2)["code"] == "REVISION_MISMATCH"


def test_folders_of_files_as_partitions(spark, tmp_path):
    """A partition may be a folder of many files, so that no task has to write or read one whole."""
    data, store = tmp_path / "d", str(tmp_path / "s")
    for k in range(2):
        spark.range(90, numPartitions=3).selectExpr(f"id + {k}.5D as x").write.parquet(str(data / f"part-{k}"))
    ask = lambda: scale.fit_incremental(spark, str(data), "x", "normal", store, by_folder=True)
    assert ask()["files"] == {"added": 2}
    spark.range(30, numPartitions=3).selectExpr("id * 2.0D as x").write.parquet(str(data / "part-2"))
    r = ask()
    x = np.concatenate([np.arange(90) + 0.5, np.arange(90) + 1.5, np.arange(30) * 2.0])
    assert r["files"] == {"kept": 2, "added": 1} and r["n"] == 210 and abs(r["params"]["mu"] - x.mean()) < 1e-9 and abs(r["params"]["sigma"] - x.std()) < 1e-9
    spark.range(5).selectExpr("id * 1.0D as x").write.mode("append").parquet(str(data / "part-0"))
    with pytest.raises(partitions.ResumeRefused):
        ask()

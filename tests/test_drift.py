"""Drift scores over a stream, against a plain loop, and after restarts."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F
from quernel.streaming import drift


def events(days=20, each=30):
    r, rows = np.random.default_rng(1), []
    for k in range(days):
        for key, shift in (("a", 0.0), ("b", 0.6 if k > 8 else 0.0), ("c", -0.8 if k > 12 else 0.0), ("new", 9.0)):
            for i in range(each):
                rows.append((key, datetime(2024, 1, 1) + timedelta(days=k, minutes=i), float(r.normal() + shift)))
    return rows


def brute(rows, ref, last_day, slack=0.5, limit=4.0):
    out = []
    for key in ref:
        up = down = 0.0
        days = sorted({t.date() for k, t, _ in rows if k == key})
        for d in days:
            x = [v for k, t, v in rows if k == key and t.date() == d]
            if d >= last_day:
                continue
            z = (np.mean(x) - ref[key][0]) * np.sqrt(len(x)) / ref[key][1]
            up, down = max(0, up + z - slack), max(0, down - z - slack)
            alarm = "RISE" if up > limit else "FALL" if down > limit else None
            out.append((key, d, len(x), round(z, 6), round(up, 6), round(down, 6), alarm))
            if alarm:
                up = down = 0.0
    return sorted(out, key=repr)


def test_equals_a_loop_over_restarts(spark, tmp_path):
    rows = events()
    schema = "key string, t timestamp, v double"
    fitted = spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.0, 1.0), ("c", 0.0, 1.0)], "key string, mean double, sd double").cache()
    for part in range(4):  # each restart finds five more days
        days = [x for x in rows if 5 * part <= (x[1] - datetime(2024, 1, 1)).days < 5 * part + 5]
        spark.createDataFrame(days, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = drift.scores(stream, fitted, "key", "t", "v").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "marks")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).withColumn("d", F.to_date("start")).collect()
    got = sorted([(r["key"], r["d"], r["n"], round(r["z"], 6), round(r["up"], 6), round(r["down"], 6), r["alarm"]) for r in got], key=repr)
    want = brute(rows, {k: (0.0, 1.0) for k in "abc"}, datetime(2024, 1, 20).date())
    assert got == want and {(g[0], g[6]) for g in got if g[6]} >= {("b", "RISE"), ("c", "FALL")} and all(g[0] != "new" for g in got)

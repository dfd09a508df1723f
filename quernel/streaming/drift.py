"""Drift of a stream from a reference fit: cumulative sums by key, kept in Spark's state store.

Every key has the sums of its windows that are open and two numbers: S = max(0, S + z - slack), with z the distance of
a window's mean from the reference in standard errors, and the same for falls.  When the watermark passes a window's
end, by new rows or by the state's own timer, it is closed, in order of windows; an alarm is told each time S passes ``limit``,
after which it starts again at 0.  A key's state is as large as the windows that ``late`` keeps open, whatever the stream's length; a
restart with the same checkpoint goes on where it stopped, and rows behind the watermark are left out.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, start bigint, n bigint, z double, up double, down double, alarm string"


def reference(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mean, sd): what each key's values look like where nothing drifts."""
    x = F.col(value).cast("double")
    return df.groupBy(F.col(key).cast("string").alias("key")).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))


def scores(stream: DataFrame, fitted: DataFrame, key: str, time: str, value: str, length: str = "1 day", late: str = "0 seconds", slack: float = 0.5, limit: float = 4.0) -> DataFrame:
    """(key, start, n, z, up, down, alarm) of each closed window; keys that ``fitted`` (key, mean, sd) lacks are left out.

    A key without spread has z = 0 where the mean is as it was, else an endless one.
    """
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    w = F.window(time, length)
    ends = [F.unix_millis(w[k]).alias(k) for k in ("start", "end")]
    rows = rows.select(F.col(key).cast("string").alias("key"), time, *ends, F.col(value).cast("double").alias("x")).filter("x is not null")
    met = rows.join(fitted.select("key", "mean", "sd"), "key")

    def each(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"open": {}, "up": 0.0, "down": 0.0}
        windows = held["open"]
        for part in [] if state.hasTimedOut else parts:
            held["mean"], held["sd"] = float(part["mean"].iloc[0]), float(part["sd"].iloc[0])
            for (start, end), x in part.groupby(["start", "end"])["x"]:
                n, total, _ = windows.get(str(start), (0, 0.0, 0))
                windows[str(start)] = n + len(x), total + float(x.sum()), int(end)
        closed, out = sorted(int(k) for k, v in windows.items() if v[2] <= state.getCurrentWatermarkMs()), []
        for start in closed:
            n, total, _ = windows.pop(str(start))
            away = total / n - held["mean"]
            z = away * math.sqrt(n) / held["sd"] if held["sd"] > 0 else math.copysign(math.inf, away) if away else 0.0
            up, down = max(0.0, held["up"] + z - slack), max(0.0, held["down"] - z - slack)
            alarm = "RISE" if up > limit else "FALL" if down > limit else None
            out.append((name[0], start, n, z, up, down, alarm))
            held["up"], held["down"] = (0.0, 0.0) if alarm else (up, down)
        state.update((json.dumps(held),))
        if windows:
            state.setTimeoutTimestamp(min(v[2] for v in windows.values()))
        yield pd.DataFrame(out, columns=["key", "start", "n", "z", "up", "down", "alarm"])

    told = met.groupBy("key").applyInPandasWithState(each, OUT, "held string", "append", GroupStateTimeout.EventTimeTimeout)
    return told.withColumn("start", F.timestamp_millis("start"))

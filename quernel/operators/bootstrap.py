"""Bootstrap of any statistic at any size: the bag of little bootstraps.

A statistic is a function of values and whole-number weights.  Some disjoint bags of ``size`` rows are dealt by hash; in each bag
resamples of the whole table's n rows are drawn as multinomial weights, so a task never holds more than one bag, and the
spread of the statistic over a bag's resamples is that of the whole table.  Ends of intervals, measured from the bag's own
value, are averaged over bags and laid around the statistic of all rows, which the caller has from an exact operator.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAGS, SIZE, RESAMPLES = 24, 20_000, 200


def weighted_quantile(q: float) -> Callable[[np.ndarray, np.ndarray], float]:
    """The least value that has a share ``q`` of the weight at or below it."""

    def of(x: np.ndarray, w: np.ndarray) -> float:
        order = np.argsort(x, kind="stable")
        total = np.cumsum(w[order])
        return float(x[order][min(np.searchsorted(total, q * total[-1]), len(x) - 1)])

    return of


def bags(df: DataFrame, columns: Sequence[str], rows: int, count: int = BAGS, size: int = SIZE, seed: int = 0, key: str | None = None) -> DataFrame:
    """(bag, columns): ``count`` disjoint bags of about ``size`` rows each; without a ``key`` of distinct values the deal depends on partitions."""
    place = F.xxhash64(F.lit(seed), F.col(key) if key else F.monotonically_increasing_id())
    if rows <= count * size:  # all rows, dealt out evenly
        return df.select(F.pmod(place, F.lit(count)).cast("int").alias("bag"), *columns)
    share = count * size / rows
    at = F.pmod(place, F.lit(1 << 40)) / float(1 << 40)
    return df.select(F.floor(at / (share / count)).cast("int").alias("bag"), *columns).filter(F.col("bag") < count)


def little_bootstraps(df: DataFrame, columns: str | Sequence[str], statistic: Callable[..., float], resamples: int = RESAMPLES, count: int = BAGS, size: int = SIZE, seed: int = 0, key: str | None = None) -> DataFrame:
    """(bag, rows, whole, replicate, value): the statistic of each bag and of each of its resamples of n rows.

    ``statistic`` takes one array for each of ``columns`` and the weights.  Rows with a null in a column are left out.
    """
    names = [columns] if isinstance(columns, str) else list(columns)
    clean = df.select(*names, *([key] if key and key not in names else [])).na.drop(subset=names)
    n = clean.count()
    dealt = bags(clean, names, n, count, size, seed, key)

    def each(group: pa.Table) -> pa.Table:
        cols = [group.column(c).to_numpy() for c in names]
        bag, b = group.column("bag")[0].as_py(), group.num_rows
        r = np.random.default_rng([seed, bag])
        whole = statistic(*cols, np.ones(b, np.int64))
        values = [statistic(*cols, r.multinomial(n, np.full(b, 1 / b))) for _ in range(resamples)]
        return pa.table({"bag": pa.array([bag] * resamples, pa.int32()), "rows": pa.array([b] * resamples), "whole": pa.array([float(whole)] * resamples), "replicate": pa.array(np.arange(resamples)), "value": pa.array(np.asarray(values, float))})

    return dealt.groupBy("bag").applyInArrow(each, "bag int, rows bigint, whole double, replicate bigint, value double")


def interval(replicates: DataFrame, estimate: float, level: float = 0.95) -> dict:
    """Estimate, standard error and basic interval from ``little_bootstraps``, each averaged over bags."""
    a = (1 - level) / 2
    away = F.col("value") - F.col("whole")
    each = replicates.groupBy("bag").agg(F.stddev_samp("value").alias("se"), F.percentile(away, F.lit(a)).alias("low"), F.percentile(away, F.lit(1 - a)).alias("high"))
    s = each.agg(F.count("*").alias("bags"), *[F.avg(c).alias(c) for c in ("se", "low", "high")]).first()
    if not s["bags"]:
        return {"estimate": estimate, "reason": "NO_DATA"}
    return {"estimate": estimate, "se": s["se"], "lower": estimate - s["high"], "upper": estimate - s["low"], "bags": s["bags"]}



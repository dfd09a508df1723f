"""Ranks of a column without a window over all rows: range partitions, totals by part, and running sums within parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import settle


def tied_ranks(df: DataFrame, value: str, weight: str | None = None) -> tuple[DataFrame, int]:
    """(x, c, before) for each distinct value with its count (or weight) and that of all smaller ones, and the total.

    Equal values are one row, so a value that many rows share is aggregated before it moves.
    """
    w = F.sum(F.col(weight).cast("double")) if weight else F.count("*")
    counts = df.select(F.col(value).cast("double").alias("x"), *([weight] if weight else [])).filter("x is not null and not isnan(x)").groupBy("x").agg(w.alias("c"))
    placed = settle(counts.repartitionByRange("x").withColumn("part", F.spark_partition_id()), "ranked")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("c").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(ahead), F.lit(0)))
    inner = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("own", F.coalesce(F.sum("c").over(inner), F.lit(0))).join(totals.select("part", "base"), "part").select("x", "c", (F.col("base") + F.col("own")).alias("before"))
    return ranked, placed.agg(F.sum("c")).first()[0] or 0


def running(placed: DataFrame, by: Sequence[str], order: str, amount: str, out: str, how=F.sum, nothing: Column | None = None) -> DataFrame:
    """``placed`` with the sum (or ``how``) of ``amount`` over all rows before each, within ``by``; ``part`` is the range that a row lies in.

    Windows run within one part of one group, and over one row for each part, so neither grows with the table.
    """
    nothing = F.lit(0) if nothing is None else nothing
    ahead = Window.unboundedPreceding, -1
    totals = placed.groupBy(*by, "part").agg(how(amount).alias("_t"))
    base = F.coalesce(how("_t").over(Window.partitionBy(*by).orderBy("part").rowsBetween(*ahead)), nothing)
    totals = totals.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("part").alias("_part"), base.alias("_base"))
    own = F.coalesce(how(amount).over(Window.partitionBy(*by, "part").orderBy(order).rowsBetween(*ahead)), nothing)
    same = F.col("part") == F.col("_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = F.greatest("_base", "_own") if how is F.max else F.col("_base") + F.col("_own")
    return placed.withColumn("_own", own).join(totals, same).withColumn(out, both).drop("_own", "_base", "_part", *[f"_{c}" for c in by])


def running_sum(placed: DataFrame, by: Sequence[str], order: str, amount: str, out: str) -> DataFrame:
    return running(placed, by, order, amount, out)


HELD, FINE = 20_000, 10_000


def quantiles(df: DataFrame, value: str, probs: Sequence[float], held: int = HELD) -> list[float | None]:
    """Exact interpolated quantiles of a column, without moving or sorting it.

    A pass brackets each rank that is needed by approximate percentiles, whose error
    is bounded, and counts what lies below and inside; passes go on inside the
    brackets, each some thousand times narrower, until these hold at most ``held``
    rows, whose distinct values are then fetched.
    """
    x = df.select(F.col(value).cast("double").alias("x")).filter("x is not null and not isnan(x)")
    s = x.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    n = s["n"]
    if not n:
        return [None] * len(probs)
    ends = [(h, int(h), min(int(h) + 1, n - 1)) for h in ((n - 1) * p for p in probs)]
    found = ranked_values(x, sorted({r for _, a, b in ends for r in (a, b)}), (n, s["lo"], s["hi"]), held)
    return [found[a] + (h - a) * (found[b] - found[a]) if found[a] != found[b] else found[a] for h, a, b in ends]


def ranked_values(x: DataFrame, ranks: Sequence[int], about: tuple[int, float, float], held: int = HELD) -> dict[int, float]:
    """The values of some ranks (from 0) of column x; ``about`` is its number of rows, least and largest value."""
    n, lo, hi = about
    bracket = {r: (lo, hi, 0, n) for r in ranks}  # least and largest value, rows below and inside
    inside = lambda a, b: (F.col("x") >= F.lit(a)) & (F.col("x") <= F.lit(b))
    while True:
        wide = [r for r, (a, b, _, m) in bracket.items() if a < b and m > held]
        if not wide:
            break
        grids = []
        for r in wide:
            a, b, below, m = bracket[r]
            at, slack = (r - below) / m, 2 / FINE
            grids.append(F.percentile_approx(F.when(inside(a, b), F.col("x")), [max(0.0, at - slack), min(1.0, at + slack)], FINE).alias(f"g{r}"))
        cut = x.agg(*grids).first()
        aims = {r: tuple(cut[f"g{r}"]) for r in wide}
        counts = x.agg(*[e for r, (a, b) in aims.items() for e in (F.count_if(F.col("x") < F.lit(a)).alias(f"b{r}"), F.count_if(inside(a, b)).alias(f"i{r}"))]).first()
        for r, (a, b) in aims.items():
            below, m = counts[f"b{r}"], counts[f"i{r}"]
            if not below <= r < below + m or m >= bracket[r][3]:  # many equal values: halve instead
                a, b, _, _ = bracket[r]
                middle = a + (b - a) / 2
                low = x.agg(F.count_if(F.col("x") <= F.lit(middle)).alias("c"), F.max(F.when(F.col("x") <= F.lit(middle), F.col("x"))).alias("top"), F.min(F.when(F.col("x") > F.lit(middle), F.col("x"))).alias("next")).first()
                a, b = (a, low["top"]) if r < low["c"] else (low["next"], b)
                got = x.agg(F.count_if(F.col("x") < F.lit(a)).alias("b"), F.count_if(inside(a, b)).alias("i")).first()
                below, m = got["b"], got["i"]
            bracket[r] = (a, b, below, m)
    out = {r: a for r, (a, b, _, _) in bracket.items() if a == b}
    left = [r for r in ranks if r not in out]
    if left:
        near = inside(*bracket[left[0]][:2])
        for r in left[1:]:
            near = near | inside(*bracket[r][:2])
        fetched = sorted((r["x"], r["c"]) for r in x.filter(near).groupBy("x").agg(F.count("*").alias("c")).collect())
        for r in left:
            a, b, before, _ = bracket[r]
            for v, c in fetched:
                if a <= v <= b:
                    if before + c > r:
                        out[r] = v
                        break
                    before += c
    return out


def grouped_quantiles(df: DataFrame, value: str, by: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """(by.., a column for each name of ``probs``): exact interpolated quantiles of groups of any size.

    Distinct values are counted, dealt out by range and summed up in two levels, so a group never has to fit a task.
    """
    x = df.select(*by, F.col(value).cast("double").alias("x")).filter("x is not null and not isnan(x)")
    counts = x.groupBy(*by, "x").agg(F.count("*").alias("c"))
    placed = settle(counts.repartitionByRange(*by, "x").withColumn("part", F.spark_partition_id()), "ranked")
    ranked = running_sum(placed, by, "x", "c", "before")
    totals = placed.groupBy(*by).agg(F.sum("c").alias("_n")).select(*[F.col(k).alias(f"_{k}") for k in by], "_n")
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    met, ends = ranked.join(totals, same), []
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        low = F.floor(h)
        for tag, rank in (("a", low), ("b", F.least(low + 1, F.col("_n") - 1))):
            ends.append(F.min(F.when(F.col("before") + F.col("c") > rank, F.col("x"))).alias(f"_{name}_{tag}"))
        ends.append(F.max(h - low).alias(f"_{name}_w"))
    out = met.groupBy(*by).agg(*ends)
    return out.select(*by, *[(F.col(f"_{k}_a") + F.col(f"_{k}_w") * (F.col(f"_{k}_b") - F.col(f"_{k}_a"))).alias(k) for k in probs])

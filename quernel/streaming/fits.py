"""Fits over streams: one-pass states are plain sums, so Spark's own streaming aggregation holds them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ranking import running
from ..plans.shared import settle


def windowed_fits(stream: DataFrame, time: str, value: str, length: str, slide: str | None = None, late: str = "1 hour", by: Sequence[str] = (), gap: str | None = None) -> DataFrame:
    """(start, end, by.., n, rate, mu, sigma) over tumbling, sliding or session windows; rows later than ``late`` are left out."""
    w = F.session_window(time, gap) if gap else F.window(time, length, slide) if slide else F.window(time, length)
    x = F.col(value).cast("double")
    g = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count(x).alias("n"), F.avg(x).alias("mu"), F.stddev_pop(x).alias("sigma"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", (1 / F.col("mu")).alias("rate"), "mu", "sigma")


def resumable_fit(stream: DataFrame, value: str, checkpoint: str, store: str, event: str | None = None) -> StreamingQuery:
    """Adds the sums of each micro-batch to ``store``, once: a batch that is replayed overwrites its own folder.

    Restarting with the same checkpoint goes on where it stopped; ``stored_fit`` reads the total at any time.
    """
    x = F.col(value).cast("double")
    e = F.col(event).cast("int") if event else F.lit(1)

    def write(batch: DataFrame, number: int) -> None:
        batch.agg(F.count(x).alias("n"), F.coalesce(F.sum(e), F.lit(0)).alias("events"), F.coalesce(F.sum(x), F.lit(0.0)).alias("exposure")).coalesce(1).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_fit(spark, store: str) -> DataFrame:
    """(n, events, exposure, rate) of all batches so far."""
    s = spark.read.parquet(store).agg(F.sum("n").alias("n"), F.sum("events").alias("events"), F.sum("exposure").alias("exposure"))
    return s.withColumn("rate", F.col("events") / F.col("exposure"))


def delivery_faults(chunks: DataFrame) -> DataFrame:
    """(source, row_start, fault): GAP, OVERLAP or DUPLICATE of row ranges (source, row_start, row_stop) delivered from outside.

    The farthest row so far is a running maximum in two levels over ranges of row_start, so a source of any length is dealt out.
    """
    once = chunks.groupBy("source", "row_start", "row_stop").agg(F.count("*").alias("c"))
    per = once.groupBy("source", "row_start").agg(F.max("row_stop").alias("row_stop"), F.sum("c").alias("c"), F.count("*").alias("kinds"))
    placed = settle(per.repartitionByRange("source", "row_start").withColumn("part", F.spark_partition_id()), "chunks")
    before = running(placed, ["source"], "row_start", "row_stop", "reached", F.max, F.lit(0).cast("bigint"))
    gap = F.when(F.col("row_start") > F.col("reached"), "GAP").when(F.col("row_start") < F.col("reached"), "OVERLAP")
    first = before.withColumn("fault", gap).filter("fault is not null").select("source", "row_start", "fault")
    twice = once.filter("c > 1").select("source", "row_start", F.lit("DUPLICATE").alias("fault"), (F.col("c") - 1).alias("c"))
    again = twice.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("c")))).select("source", "row_start", "fault")
    inner = before.filter("kinds > 1").select("source", "row_start", F.lit("OVERLAP").alias("fault"))
    return first.union(again).union(inner)

"""Connected components of an edge table by alternating large-star and small-star joins.

Each step is an aggregation and a join on a node, so that hubs are aggregated
before they are shuffled and a skewed join can be split; no neighbourhood is
gathered in a task and nothing but two counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stash


def components(edges: DataFrame, tag: str = "components", most: int = 60) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b); root is the smallest node of the component, itself included."""
    now = stash(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo <> hi").distinct(), tag)
    state = _state(now)
    for _ in range(most):
        # Large star: every larger neighbour of a node meets the smallest of the neighbourhood.
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo <> hi").distinct()
        large = stash(large, tag)
        # Small star: a node and its smaller neighbours meet the smallest of them.
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        met = large.select(F.col("hi").alias("u"), F.col("lo").alias("v")).join(least, "u")
        small = met.select(F.col("m").alias("lo"), F.col("v").alias("hi")).union(least.select(F.col("m").alias("lo"), F.col("u").alias("hi")))
        now = stash(small.filter("lo <> hi").distinct(), tag)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first()
    return row[0], row[1]

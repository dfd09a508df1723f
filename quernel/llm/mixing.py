"""Mixing sources to target weights by pivotal dependent rounding, in Spark SQL functions only.

Every document of a source should be taken ``target / source size`` times.  The
whole part is given to all; the fraction becomes a probability, and pairs of
documents transfer words between each other at random until one of the two has
probability 0 or 1 (each keeps its expectation, and the words of the pair stay
constant).  Blocks of at most about ``BLOCK`` documents do this side by side
and each hands one undecided document to the next level of a tree, until each
source has one; that one is rounded to the nearer side, so that its expectation
alone isn't kept.  A source misses its target by no more than half its last
undecided document.

Defined results: null or empty texts have size 0 and are taken 0 times; a null
source is a source of its own, last in order; rows that repeat, even with the
same doc_id, are separate documents; doc_id may have any type that can be ordered;
texts may have any length; a table without words takes nothing; other columns are
ignored by ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import running_sum
from .store import stash

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 64
WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sources: DataFrame, share: float, most: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``target`` for each (source, source_size): ``share`` of all sizes dealt by weight, no source above ``most`` times its size.

    With sources sorted by cap per weight, those that reach their cap are a
    prefix, so running sums find the level at which the rest is filled.  Places and
    sums are taken in two levels over ranges of sources, so any number of them is
    dealt out; the one level reaches all of them as a row.
    """
    by_name = F.col("source").asc_nulls_last()
    placed = stash(sources.withColumn("one", F.lit(1)).repartitionByRange(by_name).withColumn("part", F.spark_partition_id()), "sources_by_name")
    ranked = running_sum(placed, [], by_name, "one", "at").drop("part", "one")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("rise", F.struct(F.col("cap") / F.col("weight"), "at"))
    risen = stash(ranked.repartitionByRange("rise").withColumn("part", F.spark_partition_id()), "sources_by_rise")
    summed = running_sum(running_sum(risen, [], "rise", "cap", "caps"), [], "rise", "weight", "weights")
    whole = risen.agg(F.sum("source_size").alias("sizes"), F.sum("weight").alias("all_weights"))
    level = (F.col("sizes") * F.lit(share) - F.col("caps")) / (F.col("all_weights") - F.col("weights"))
    levels = summed.crossJoin(whole).withColumn("level", level)  # one row
    fill = levels.agg(F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct("rise", "level")))["level"].alias("fill"))
    return ranked.crossJoin(fill).withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("fill") * F.col("weight"), F.col("cap")))).select(*sources.columns, "target")  # one row


def _uniform(level: int, seed: int, *columns: str | Column) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), *columns), 11)
    return bits / F.lit(float(1 << 53))


def _step(state: Column, x: Column) -> Column:
    """Put the undecided document of ``state`` against ``x``; one of them is decided."""
    c = state["open"]
    up = F.least((1 - c["p"]) * c["size"], x["p"] * x["size"])
    down = F.least(c["p"] * c["size"], (1 - x["p"]) * x["size"])
    rises = x["u"] * (up + down) < down
    moved = F.when(rises, up).otherwise(-down)
    c_ends = F.when(rises, (1 - c["p"]) * c["size"] <= x["p"] * x["size"]).otherwise(c["p"] * c["size"] <= (1 - x["p"]) * x["size"])
    done = F.when(c_ends, _decided(c, rises.cast("int"))).otherwise(_decided(x, (~rises).cast("int")))
    left_p = F.when(c_ends, x["p"] - moved / x["size"]).otherwise(c["p"] + moved / c["size"])
    left = F.when(c_ends, x).otherwise(c)
    kept = F.struct(*[left[n].alias(n) for n in ("size", "doc_id", "rep", "u")], F.greatest(F.lit(0.0), F.least(F.lit(1.0), left_p)).alias("p"))
    return F.struct(kept.alias("open"), F.array_append(state["done"], done).alias("done"))


def _decided(x: Column, extra: Column) -> Column:
    return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), extra.alias("extra"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) for each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")
    size = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(size)
    counted = stash(docs.select("doc_id", "source", size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    sources = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("docs"))
    sources = stash(source_targets(sources, share, most, weights).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "sources")
    largest = sources.agg(F.max("docs")).first()[0] or 0

    one = counted.withColumn("rep", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
    one = one.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "source_size", "target", "docs", F.floor("rate").cast("int").alias("base"), (F.col("rate") - F.floor("rate")).alias("p"))
    fixed = (F.col("size") == 0) | (F.col("p") == 0)
    keys = ["source", "source_size", "target", "base"]
    out = [one.filter(fixed).select("doc_id", "size", *keys, F.lit(0).alias("extra"))]

    entry = F.struct("size", "doc_id", "rep", F.col("u"), "p")
    now = one.filter(~fixed).withColumn("u", _uniform(0, seed, "doc_id", "rep", "size")).select(*keys, "docs", entry.alias("open"))
    levels = max(1, math.ceil(math.log(max(largest, 2), BLOCK / 2)))
    for level in range(1, levels + 1):
        blocks = F.ceil(F.col("docs") / F.lit(BLOCK / 2)).cast("long") if level < levels else F.lit(1).cast("long")
        block = F.when(blocks > 1, F.pmod(F.xxhash64(F.lit(level), "open.doc_id", "open.rep", "open.size"), blocks)).otherwise(F.lit(0).cast("long"))
        grouped = now.withColumn("docs", blocks).groupBy(*keys, "docs", block.alias("block")).agg(F.collect_list("open").alias("members"))
        rows = F.reverse(F.array_sort("members"))
        empty = F.array().cast(f"array<struct<doc_id:{kind},size:bigint,extra:int>>")
        start = F.struct(rows[0].alias("open"), empty.alias("done"))
        tree = grouped.select(*keys, "docs", F.aggregate(F.slice(rows, 2, F.size("members")), start, _step).alias("r"))
        tree = stash(tree.select(*keys, "docs", "r.open", "r.done"), f"level{level}")
        out.append(tree.select(*keys, F.explode("done").alias("x")).select("x.doc_id", "x.size", *keys, "x.extra"))
        fresh = F.struct("open.size", "open.doc_id", "open.rep", _uniform(level, seed, "open.doc_id", "open.rep", "open.size").alias("u"), "open.p")
        now = tree.select(*keys, "docs", fresh.alias("open"))
    out.append(now.select("open.doc_id", "open.size", *keys, (F.col("open.p") >= 0.5).cast("int").alias("extra")))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    copies = F.col("base") + F.col("extra")
    return result.select("doc_id", "size", "source", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; other columns stay, whatever their names."""
    named = docs.columns
    docs = docs.toDF(*[c if c in ("doc_id", "text", "source") else f"other{i}" for i, c in enumerate(named)])
    plan = stash(mix(docs, **settings).select("doc_id", F.col("source").alias("_mix_source"), F.col("size").alias("_mix_size"), "copies"), "mix")
    per = plan.groupBy("doc_id", "_mix_source", "_mix_size").agg(F.sum("copies").alias("_mix_copies"), F.count("*").alias("_mix_rows"))
    size = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).cast("long")
    sized = docs.withColumn("_mix_sz", size).alias("d")
    joined = sized.join(per.filter("_mix_copies > 0").alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.source").eqNullSafe(F.col("m._mix_source")) & (F.col("d._mix_sz") == F.col("m._mix_size")))
    each = F.col("_mix_copies")
    if per.filter("_mix_rows > 1").limit(1).count():  # rows that share id, source and size deal their copies out evenly
        twins = joined.filter("_mix_rows > 1").select(*[F.col(f"d.{c}") for c in docs.columns], "_mix_sz", "_mix_copies", "_mix_rows")
        twins = twins.withColumn("_mix_key", F.xxhash64("doc_id", "source", "_mix_sz")).withColumn("_mix_hash", F.xxhash64("text")).withColumn("_mix_one", F.lit(1))
        placed = stash(twins.repartitionByRange("_mix_key", "_mix_hash", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "twins")
        keys = ["_mix_key", "doc_id", "source", "_mix_sz"]
        placed = running_sum(placed, keys, "_mix_hash", "_mix_one", "_mix_at").withColumn("_mix_at", F.col("_mix_at") + 1).alias("d")
        joined = joined.filter("_mix_rows = 1").withColumn("_mix_at", F.lit(1))
        plain = [*docs.columns, "_mix_copies", "_mix_rows", "_mix_at"]
        joined = joined.select(*[F.col(f"d.{c}") for c in docs.columns], *plain[-3:]).unionByName(placed.select(*plain)).alias("d")
        each = F.floor(each / F.col("_mix_rows")) + (F.col("_mix_at") <= each % F.col("_mix_rows")).cast("int")
    joined = joined.withColumn("_mix_each", each.cast("int")).filter("_mix_each > 0")
    return joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_each")))).select(*[F.col(f"d.{c}") for c in docs.columns]).toDF(*named)

"""Inputs as partitions: Parquet files with fingerprints, a table of partial states, and incremental fits from it.

A state row holds the sums of one partition; fits add them up.  When files come,
change or go, only the new and changed ones are read again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import settle


class ResumeRefused(ValueError):
    """Stored states don't belong to this input, and the caller did not allow the difference."""


def _place(by_folder: bool) -> Column:
    """What a row's partition is called: its file, or the folder that this lies in."""
    file = F.col("_metadata.file_path")
    return F.regexp_replace(file, "/[^/]*$", "") if by_folder else file


def parquet_values(spark: SparkSession, path: str, column: str, by_folder: bool = False) -> DataFrame:
    """One column (x) of a file or of all files under a folder; Parquet reads no other."""
    found = spark.read.option("recursiveFileLookup", "true").parquet(path)
    if found.columns.count(column) != 1:
        raise ValueError(f"{column} must be there exactly once")
    return found.select(F.col(column).cast("double").alias("x"), _place(by_folder).alias("partition_id"))


def fingerprints(spark: SparkSession, path: str, content: bool = False, by_folder: bool = False) -> DataFrame:
    """(partition_id, fingerprint) of each file, or of each folder with files: of sizes and times, or of what rows hold, in any order.

    Contents are hashed row by row and added up, so a file of any size is read in splits by as many tasks as it has.
    """
    if content:
        rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
        h = F.xxhash64(*rows.columns)
        each = rows.select(_place(by_folder).alias("partition_id"), h.alias("h"), F.xxhash64(F.lit(1), h).alias("g")).groupBy("partition_id")
        sums = each.agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("a"), F.bit_xor("g").alias("b"))
        return sums.select("partition_id", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in "nab"]).cast("binary"), 256).alias("fingerprint"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    if by_folder:
        h = F.xxhash64("_metadata.file_path", "length", F.col("modificationTime").cast("string"))
        sums = files.select(_place(True).alias("partition_id"), h.alias("h")).groupBy("partition_id").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("a"))
        return sums.select("partition_id", F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("a").cast("string")).cast("binary"), 256).alias("fingerprint"))
    mark = F.sha2(F.concat_ws("|", F.col("length").cast("string"), F.col("modificationTime").cast("string")).cast("binary"), 256)
    # The same column names files here and where their values are read.
    return files.select(F.col("_metadata.file_path").alias("partition_id"), mark.alias("fingerprint"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(partition_id, change): kept, changed, removed or added, from (partition_id, fingerprint) of both."""
    a = old.select("partition_id", F.col("fingerprint").alias("was"))
    b = new.select("partition_id", F.col("fingerprint").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "kept").otherwise("changed")
    return a.join(b, "partition_id", "full_outer").select("partition_id", change.alias("change"))


STATE = "partition_id string, fingerprint string, n bigint, mean double, m2 double, nl bigint, meanl double, m2l double, low double, high double"


def states(values: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """State rows from (partition_id, x): counts, means and squared distances from them, of values and of their logarithms."""
    x = F.col("x")
    lx = F.when(x > 0, F.log("x"))
    sums = [e for tag, v in (("", x), ("l", lx)) for e in (F.count(v).alias(f"n{tag}"), F.avg(v).alias(f"mean{tag}"), (F.var_pop(v) * F.count(v)).alias(f"m2{tag}"))]
    out = values.groupBy("partition_id").agg(*sums, F.min("x").alias("low"), F.max("x").alias("high"))
    return out.join(prints, "partition_id") if prints is not None else out.withColumn("fingerprint", F.lit(None).cast("string"))


def merged_sums(rows: DataFrame) -> DataFrame:
    """One row of n, mean, var, low, high and the same of logarithms (nl, ml, vl) from states; distances are from the common mean, so nothing cancels."""
    some = rows.filter("n > 0")
    mean = lambda tag: F.sum(F.col(f"n{tag}") * F.col(f"mean{tag}")) / F.nullif(F.sum(f"n{tag}"), F.lit(0))
    counts = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "nl")]
    common = some.agg(mean("").alias("mean"), mean("l").alias("ml"), *counts, F.min("low").alias("low"), F.max("high").alias("high"))
    far = lambda tag, c: F.sum(F.col(f"m2{tag}") + F.col(f"n{tag}") * (F.col(f"mean{tag}") - F.col(c)) * (F.col(f"mean{tag}") - F.col(c)))
    centres = common.select(F.col("mean").alias("c"), F.col("ml").alias("cl"))
    spread = some.crossJoin(centres).agg(far("", "c").alias("m2"), far("l", "cl").alias("m2l"))  # with one row
    s = common.crossJoin(spread)  # one row by one row
    return s.select("n", "nl", "mean", (F.col("m2") / F.nullif("n", F.lit(0))).alias("var"), "ml", (F.col("m2l") / F.nullif("nl", F.lit(0))).alias("vl"), "low", "high")


def merge(rows: DataFrame) -> DataFrame:
    """One row of exponential, normal and lognormal estimates from states."""
    s, positive = merged_sums(rows), F.col("low") > 0
    logs = [F.when(positive, F.col("ml")).alias("mu_log"), F.when(positive, F.sqrt("vl")).alias("sigma_log")]
    return s.select("n", (1 / F.nullif("mean", F.lit(0.0))).alias("rate"), F.col("mean").alias("mu"), F.sqrt("var").alias("sigma"), *logs)


def generations(spark: SparkSession, store: str) -> list[int]:
    """Complete generations in a store: those whose write left Spark's success mark."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/generation=*/_SUCCESS")
    paths = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found)
    return sorted(int(str(f.getPath().getParent().getName()).split("=")[1]) for f in paths or [])


def bound_job(spark: SparkSession, store: str, job: str) -> bool:
    """Whether ``store`` belongs to ``job``, a text; a store without a job becomes its own."""
    if generations(spark, f"{store}/job"):
        return spark.read.option("wholetext", "true").text(f"{store}/job/generation=0").first()[0].rstrip("\n") == job
    spark.range(1).select(F.lit(job).alias("value")).coalesce(1).write.mode("overwrite").text(f"{store}/job/generation=0")
    return True


def refreshed(spark: SparkSession, path: str, column: str, store: str, recompute_changed: bool = False, allow_removed: bool = False, by_folder: bool = False) -> tuple[DataFrame, dict]:
    """States of all files of ``path``, with the number of files kept, added, changed and removed; ``by_folder`` all files of a folder count as one.

    States live as Parquet in ``store``, a folder for each generation, which Spark
    marks as complete once all of it is written; the latest complete one is in
    force, so a failure leaves the one before.  File lists stay in Spark.  A store belongs to
    one column (else JOB_CHANGED).
    """
    if not bound_job(spark, store, json.dumps({"column": column, "state": STATE, **({"by_folder": True} if by_folder else {})}, sort_keys=True)):
        raise ResumeRefused("JOB_CHANGED")
    new = settle(fingerprints(spark, path, by_folder=by_folder), "fingerprints")
    done = generations(spark, store)
    at = done[-1] if done else 0
    old = spark.read.schema(STATE).parquet(f"{store}/generation={at}") if at else spark.createDataFrame([], STATE)
    diff = settle(manifest_diff(old, new), "manifest")
    seen = {r["change"]: r["count"] for r in diff.groupBy("change").count().collect()}
    if seen.get("changed") and not recompute_changed:
        raise ResumeRefused("PARTITION_CHANGED")
    if seen.get("removed") and not allow_removed:
        raise ResumeRefused("PARTITION_MISSING")
    now = old.join(diff.filter("change = 'kept'"), "partition_id", "left_semi")
    todo = diff.filter("change in ('added', 'changed')").select("partition_id")
    if seen.get("added") or seen.get("changed"):
        values = parquet_values(spark, path, column, by_folder).join(todo, "partition_id", "left_semi")
        # A file without rows has a state of no values.
        fresh = new.join(todo, "partition_id", "left_semi").join(states(values).drop("fingerprint"), "partition_id", "left")
        now = now.unionByName(fresh.fillna(0, ["n", "nl"]).select(*old.columns))
    target = f"{store}/generation={at + 1}"
    now.select(*old.columns).write.mode("overwrite").parquet(target)  # an unfinished one of this number is replaced
    return spark.read.schema(STATE).parquet(target), seen


def incremental(spark: SparkSession, path: str, column: str, store: str, recompute_changed: bool = False, allow_removed: bool = False) -> tuple[DataFrame, dict]:
    """Estimates over all files of ``path``, of which only new and changed ones are read; see ``refreshed``."""
    rows, seen = refreshed(spark, path, column, store, recompute_changed, allow_removed)
    return merge(rows), seen


def provenance(df: DataFrame, fit: dict, **more) -> str:
    """Canonical JSON of what was fitted from what: sorted keys, no spaces."""
    from ..operators.evidence import files_listed

    files = files_listed(df)
    mark = F.sum(F.xxhash64("path", "length", F.col("modified").cast("string")).cast("decimal(38,0)")).alias("digest")
    digest = files.agg(F.count("*").alias("files"), mark).first() if files is not None else {"files": 0, "digest": 0}
    about = {"rows": df.count(), "files": digest["files"], "files_digest": str(digest["digest"]), "spark": df.sparkSession.version, "fit": fit, **more}
    return json.dumps(about, sort_keys=True, separators=(",", ":"), default=str)

"""Strict reading of lifetimes from CSV: header ``time,event_observed``, two fields, plain decimal times, events 0 or 1.

A file starts with the header (a byte order mark may stand before it); blank lines may stand at its
end only; every other line is a row.  Lines keep their order within a split of a file, so the first line of
the split at offset 0 is the header's, and a blank line is inside where rows follow in its split or a later one.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import settle

HEADER = "time,event_observed"
TIME = r"^(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


class CsvRefused(ValueError):
    """The input breaks the rules; the message says which one and in how many rows."""


#: A whole line that breaks no rule and whose time is surely a double; all others are looked at more closely.
PLAIN_LINE = r"^(0|[1-9][0-9]{0,299})(\.[0-9]{1,300})?,[01]\r?\z"


def _broken() -> Column:
    """The rule that ``line``, without a carriage return at its end, breaks by itself."""
    parts = F.split("line", ",", -1)
    time, event = parts[0], F.get(parts, F.lit(1))
    value = F.expr("try_cast(split(line, ',', -1)[0] as double)")
    code = (
        F.when(F.col("line") == "", "BLANK").when(F.contains("line", F.lit("\ufffd")), "ENCODING").when(F.size(parts) != 2, "FIELDS").when(~time.rlike(TIME), "TIME").when(value.isNull() | (F.abs(value) == float("inf")), "TIME_RANGE")
        .when((value == 0) & time.rlike("[1-9]") & ~time.rlike(r"^0(\.0+)?([eE]|$)"), "TIME_RANGE").when(~event.isin("0", "1"), "EVENT")
    )
    return F.when(~F.col("plain"), code)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, at, id, line, code): each line with the rule it breaks by itself, or null; ``id`` grows within a split.

    One pattern passes sound lines; only what fails it is cut and classified.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), "value", F.col("value").rlike(PLAIN_LINE).alias("plain"),
    )
    trimmed = F.regexp_replace(F.regexp_replace("value", "\r\\z", ""), "^\ufeff(?=time,)", "")
    lines = lines.withColumn("line", F.when(F.col("plain"), F.col("value")).otherwise(trimmed))
    return lines.select("file", "at", "id", "line", _broken().alias("code"))


def _time() -> Column:
    return F.expr("cast(substring_index(line, ',', 1) as double)")


def _event() -> Column:
    return F.expr("contains(line, ',1')")


def _without_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Files of no bytes, which no scan visits."""
    found = 0
    for p in paths:
        pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for top in fs.globStatus(pattern) or []:
            for f in fs.listStatus(top.getPath()) if top.isDirectory() else [top]:
                found += f.isFile() and f.getLen() == 0 and not f.getPath().getName().startswith(("_", "."))
    return found


BY_LINE = ("ENCODING", "FIELDS", "TIME", "TIME_RANGE", "EVENT")


def _splits(lines: DataFrame) -> DataFrame:
    """What each split of a file holds: its first line, where blank and full lines stand, broken rules, and sums of sound lines."""
    blank, sound = F.col("code") == "BLANK", F.col("code").isNull()
    return lines.groupBy("file", "at").agg(
        F.min("id").alias("first"), F.min(F.when(F.col("line") == HEADER, F.col("id"))).alias("head"), F.max(F.when(~F.coalesce(blank, F.lit(False)), F.col("id"))).alias("full"), F.min(F.when(blank, F.col("id"))).alias("empty"),
        *[F.count_if(F.col("code") == c).alias(c) for c in BY_LINE],
        F.count_if(sound).alias("n"), F.count_if(sound & _event()).alias("events"), F.sum(F.when(sound, _time())).alias("exposure"),
    )


def _told(spark: SparkSession, splits: DataFrame, path: str | list[str]) -> DataFrame:
    """(code, rows) from what splits hold."""
    files = splits.groupBy("file").agg(
        F.count_if((F.col("at") == 0) & (F.col("head") == F.col("first"))).alias("headers"), F.max(F.when(F.col("full").isNotNull(), F.col("at"))).alias("last"),
    )
    whole = _without_bytes(spark, [path] if isinstance(path, str) else path)
    inner = (F.col("empty") < F.col("full")) | (F.col("empty").isNotNull() & (F.col("at") < F.col("last")))
    blanks = splits.join(files, "file").filter(inner).agg(F.lit("BLANK").alias("code"), F.count("*").alias("rows"))
    heads = files.agg(F.lit("HEADER").alias("code"), (F.count_if(F.col("headers") == 0) + F.lit(whole)).alias("rows"))
    # The header itself reads as a line whose time is no number.
    counted = splits.agg(*[F.sum(c).alias(c) for c in BY_LINE]).crossJoin(files.agg(F.sum("headers").alias("h")))  # one row by one row
    rows = [F.struct(F.lit(c).alias("code"), (F.coalesce(F.col(c), F.lit(0)) - (F.coalesce("h", F.lit(0)) if c == "TIME" else 0)).alias("rows")) for c in BY_LINE]
    return heads.union(blanks).union(counted.select(F.explode(F.array(*rows)).alias("e")).select("e.*")).filter("rows > 0")


def violations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(code, rows): rules that files of ``path`` break; none if all are sound. Codes: HEADER, BLANK, ENCODING, FIELDS, TIME, TIME_RANGE, EVENT."""
    return _told(spark, settle(_splits(read_lines(spark, path)), "splits"), path)


def read_lifetimes(spark: SparkSession, path: str | list[str], check: bool = True, files: bool = False) -> DataFrame:
    """(time, event) of all files, and ``file`` if asked; files that break a rule are refused first, unless ``check`` is off."""
    if check:
        refuse(violations(spark, path))
    sound = read_lines(spark, path).filter("code is null")
    return sound.select(_time().alias("time"), _event().alias("event"), *(["file"] if files else []))


def refuse(broken: DataFrame) -> None:
    bad = broken.orderBy("code").collect()  # one row for each code
    if bad:
        raise CsvRefused(", ".join(f"{r['code']} in {r['rows']} places" for r in bad))


def fit(spark: SparkSession, path: str | list[str]) -> dict:
    """Exponential fit of strict CSV files in one pass that checks and sums: code, n, events, exposure, rate, loglik.

    Files that break a rule give FORMAT_MISMATCH and ``broken``, rows by code.
    """
    splits = settle(_splits(read_lines(spark, path)), "splits")
    bad = {r["code"]: r["rows"] for r in _told(spark, splits, path).collect()}
    if bad:
        return {"code": "FORMAT_MISMATCH", "broken": bad}
    s = splits.agg(*[F.sum(c).alias(c) for c in ("n", "events", "exposure")]).first()
    n, events, exposure = s["n"] or 0, s["events"] or 0, s["exposure"] or 0.0
    code = "EMPTY_SAMPLE" if not n else "NO_OBSERVED_EVENTS" if not events else "UNBOUNDED_LIKELIHOOD" if exposure <= 0 else "OK"
    rate = events / exposure if code == "OK" else None
    return {"code": code, "n": n, "events": events, "exposure": exposure, "rate": rate, "loglik": events * math.log(rate) - events if rate else None, "passes": 1}


SUMS = "file string, length bigint, modified timestamp, n bigint, events bigint, exposure double"


def checkpointed_fit(spark: SparkSession, path: str, store: str, source_id: str, files_each: int = 1000, cancel: Callable[[], bool] = lambda: False) -> dict:
    """Exponential fit of strict CSV files, file by file: code COMPLETE, CANCELLED, or a refusal, with what is covered.

    The sums of up to ``files_each`` files at a time are written as one step, which
    Spark's success mark makes complete; a later call goes on after the last one.
    A store belongs to one ``source_id`` and one form of rows (else SOURCE_MISMATCH); files whose size or time has changed since
    their step are refused (REVISION_MISMATCH), and so are files that break a rule of the form
    (FORMAT_MISMATCH, with ``broken``, rows by code; steps before them stay).
    """
    from ..operators.evidence import glob_safe
    from .partitions import bound_job, generations

    marks = generations(spark, store)
    if not bound_job(spark, store, json.dumps({"source": source_id, "schema": HEADER}, sort_keys=True)):
        return {"code": "SOURCE_MISMATCH"}
    # Files are known by the name that their lines carry; ``path`` is what a reader takes.
    listed = spark.read.format("binaryFile").load(path)
    files = settle(listed.select(F.col("_metadata.file_path").alias("file"), "path", "length", F.col("modificationTime").alias("modified")), "files")
    total, code, broken = files.count(), "COMPLETE", {}

    def so_far() -> DataFrame:
        steps = [f"{store}/generation={m}" for m in marks]
        return spark.read.schema(SUMS).parquet(*steps) if steps else spark.createDataFrame([], SUMS)

    changed = so_far().alias("a").join(files.alias("b"), "file", "left").filter("b.length is null or a.length <> b.length or a.modified <> b.modified")
    if changed.limit(1).count():
        return {"code": "REVISION_MISMATCH"}
    while True:
        todo = files.join(so_far(), "file", "left_anti").orderBy("file").limit(files_each)
        names = [r["path"] for r in todo.select("path").collect()]  # at most files_each
        if not names:
            break
        if cancel():
            code = "CANCELLED"
            break
        safe = [glob_safe(n) for n in names]
        splits = settle(_splits(read_lines(spark, safe)), "splits")
        broken = {r["code"]: r["rows"] for r in _told(spark, splits, safe).collect()}
        if broken:
            code = "FORMAT_MISMATCH"
            break
        sums = splits.groupBy("file").agg(*[F.sum(c).alias(c) for c in ("n", "events", "exposure")])
        number = (marks[-1] if marks else 0) + 1
        step = settle(todo.join(sums, "file", "left").select("file", "length", "modified", "n", "events", F.coalesce("exposure", F.lit(0.0)).alias("exposure")), "step")
        if step.filter("n is null").limit(1).count():  # a sound file has a header at least
            raise RuntimeError("files were listed whose lines were not read")
        step.write.mode("overwrite").parquet(f"{store}/generation={number}")
        marks = [*marks, number]
    s = so_far().agg(F.count("*").alias("files"), F.sum("n").alias("n"), F.sum("events").alias("events"), F.sum("exposure").alias("exposure")).first()
    out = {"code": code, "files": total, "files_done": s["files"], "steps": len(marks), "n": s["n"] or 0, "events": s["events"] or 0, "exposure": s["exposure"] or 0.0}
    return {**out, **({"broken": broken} if broken else {}), "rate": s["events"] / s["exposure"] if s["events"] and s["exposure"] else None}

"""What goes with a result: digests of inputs and parameters, coverage of row ranges, outcomes, canonical JSON and plain summaries."""

from __future__ import annotations

import hashlib
import json
import math
import re
from urllib.parse import unquote

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.families import family
from ..plans.shared import settle
from .ranking import running


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; numbers that JSON lacks are strings."""
    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        if isinstance(v, np.generic):
            v = v.item()
        return str(v) if isinstance(v, float) and not math.isfinite(v) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(tag: str, *parts: str) -> str:
    """sha256 of a tag and parts, each behind its length in bytes, so that no two lists of parts read alike."""
    h = hashlib.sha256()
    for p in (tag, *parts):
        raw = p.encode()
        h.update(f"{len(raw)}:".encode() + raw)
    return h.hexdigest()


def digest_column(tag: str, *parts: str | Column) -> Column:
    """``digest`` of columns; a null counts as a part of its own kind."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    pieces = [F.lit(f"{len(tag.encode())}:{tag}")]
    for c in cols:
        text = c.cast("string")
        pieces.append(F.when(c.isNull(), "-:").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*pieces).cast("binary"), 256)


def chunk_id(source: str | Column, start: str | Column, stop: str | Column) -> Column:
    """A name of the rows start (inclusive) to stop of a source."""
    return F.concat(F.lit("chunk_"), F.substring(digest_column("chunk", source, start, stop), 1, 32))


def parameter_fingerprint(name: str, params) -> str:
    """A digest of a family and its parameters, exact in every bit."""
    return digest("parameters", family(name).name, *[float(p).hex() for p in params])


def plan_text(df: DataFrame) -> str:
    """The plan of ``df`` with all its expressions and literals, the same for equal plans of any session."""
    conf, key = df.sparkSession.conf, "spark.sql.debug.maxToStringFields"
    before = conf.get(key)
    conf.set(key, str(1 << 30))
    try:
        return df._jdf.queryExecution().analyzed().canonicalized().toString()
    finally:
        conf.set(key, before)


def files_listed(df: DataFrame) -> DataFrame | None:
    """(path, length, modified) of the files behind ``df``, from a listing; no file is opened.  None where there are none."""
    names = [glob_safe(unquote(n)) for n in df.inputFiles()]
    if not names:
        return None
    listed = df.sparkSession.read.format("binaryFile").load(names)
    return listed.select("path", "length", F.col("modificationTime").alias("modified"))


def glob_safe(path: str) -> str:
    """A path that Spark's readers take as it stands, whatever marks of patterns it holds."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def source_digest(df: DataFrame) -> str:
    """Digest of the plan and of what it reads: names, sizes and times of files, and rows where some come from memory.

    Plans over files alone take a listing and no pass over the data; others take one pass.
    """
    about = [digest("plan", plan_text(df))]
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    kinds = {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())}
    files = files_listed(df)
    if files is not None:
        mark = F.xxhash64("path", "length", F.col("modified").cast("string"))
        r = files.agg(F.count("*").alias("n"), F.sum(mark.cast("decimal(38,0)")).alias("h")).first()
        about.append(digest("files", str(r["n"]), str(r["h"])))
    if not kinds <= {"LogicalRelation", "Range", "OneRowRelation"}:
        about.append(row_digest(df))
    return digest("source", *about)


def replay(df: DataFrame, tag: str = "replay") -> tuple[DataFrame, str]:
    """``df`` written once, and a digest of its rows in any order, by which ``verify`` tells whether a later reading is the same."""
    kept = settle(df, tag)
    return kept, row_digest(kept)


def row_digest(df: DataFrame) -> str:
    h = F.xxhash64(*df.columns)
    r = df.select(h.alias("h"), F.xxhash64(F.lit(1), h).alias("g")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("a"), F.bit_xor("g").alias("b")).first()
    return digest("rows", *[str(r[k]) for k in "nab"])


def verify(df: DataFrame, expected: str) -> None:
    if row_digest(df) != expected:
        raise ValueError("DIGEST_MISMATCH")


def coverage(chunks: DataFrame) -> DataFrame:
    """(source, row_start, row_stop): row ranges of each source joined where they touch or overlap, in two levels over ranges of row_start."""
    per = chunks.filter("row_stop > row_start").groupBy("source", "row_start").agg(F.max("row_stop").alias("row_stop"))
    placed = settle(per.repartitionByRange("source", "row_start").withColumn("part", F.spark_partition_id()), "ranges")
    reached = running(placed, ["source"], "row_start", "row_stop", "reached", F.max, F.lit(-1).cast("bigint"))
    fresh = settle(reached.withColumn("fresh", (F.col("row_start") > F.col("reached")).cast("bigint")), "fresh")
    marked = running(fresh, ["source"], "row_start", "fresh", "earlier")
    island = (F.col("earlier") + F.col("fresh")).alias("island")
    return marked.groupBy("source", island).agg(F.min("row_start").alias("row_start"), F.max("row_stop").alias("row_stop")).select("source", "row_start", "row_stop")


def outcomes(covered: DataFrame, expected: DataFrame) -> DataFrame:
    """(source, rows, row_count, outcome): COMPLETE, PARTIAL or FAILED, from covered ranges and (source, row_count)."""
    rows = covered.groupBy("source").agg(F.sum(F.col("row_stop") - F.col("row_start")).alias("rows"))
    got = expected.join(rows, "source", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    state = F.when(F.col("rows") == F.col("row_count"), "COMPLETE").when(F.col("rows") > 0, "PARTIAL").otherwise("FAILED")
    return got.select("source", "rows", "row_count", state.alias("outcome"))


def zip_weights(values: DataFrame, weights: DataFrame, index: str = "row") -> DataFrame:
    """Values and weights of equal row numbers side by side; a row that either side lacks is an error, a null entry is not."""
    met = values.withColumn("_has_value", F.lit(True)).join(weights.withColumn("_has_weight", F.lit(True)), index, "full_outer")
    columns = [c for c in (*values.columns, *weights.columns) if c != index]
    lack = met.agg(F.count_if(F.col("_has_value").isNull() | F.col("_has_weight").isNull()).alias("c")).first()["c"]
    if lack:
        raise ValueError(f"LENGTH_MISMATCH: {lack} rows lack a value or a weight")
    return met.select(index, *columns)


def log_density_outcomes(df: DataFrame, value: str, name: str, params) -> DataFrame:
    """(value, log_density, code): ln of the density, or why there is none: nonfinite_observation, support_violation, nonfinite_log_density."""
    from ..functions.families import column

    x = F.col(value).cast("double")
    d = df.select(x.alias("value")).withColumn("d", column(name, "logpdf", F.col("value"), *params))
    endless = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    code = F.when(F.col("value").isNull() | endless("value"), "nonfinite_observation").when(F.col("d") == float("-inf"), "support_violation").when(endless("d"), "nonfinite_log_density")
    return d.select("value", F.when(code.isNull(), F.col("d")).alias("log_density"), code.alias("code"))


def result_json(fitted: dict) -> str:
    """Canonical JSON of a fit without what differs from run to run."""
    return canonical({k: v for k, v in fitted.items() if k not in ("ledger", "seconds")})


def summary(fitted: dict) -> str:
    """A plain table of a fit."""
    rows = [("family", fitted["family"]), ("code", fitted["code"]), ("n", fitted.get("n")), *fitted.get("params", {}).items(), *[(k, fitted[k]) for k in ("loglik", "aic", "bic", "passes") if fitted.get(k) is not None]]
    wide = max(len(k) for k, _ in rows)
    return "\n".join(f"{k:<{wide}}  {f'{v:.6g}' if isinstance(v, float) else v}" for k, v in rows)


def explain(fitted: dict) -> str:
    """One sentence on what the parameters say about the sample."""
    f = family(fitted["family"])
    if fitted["code"] != "OK":
        return f"No {f.name} distribution was fitted: {fitted['code']}."
    p = tuple(fitted["params"].values())
    q = [float(v) for v in f.quantile(np.array([0.05, 0.5, 0.95]), *p)]
    mean = f"a mean of {f.mean(*p):.6g}, " if f.mean and math.isfinite(f.mean(*p)) else ""
    return f"A {f.name} distribution fitted to {fitted['n']} values has {mean}a median of {q[1]:.6g}, and 90 % of its mass between {q[0]:.6g} and {q[2]:.6g}."

"""Intermediate tables in the folder that all executors share, and Arrow mapping helpers."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one is set only where none is, and only on a local master, whose executors share the machine's folders."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = Path(tempfile.gettempdir(), f"quernel-{os.getuid()}").as_uri()
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


_scopes: list[str] = []


def _own(spark: SparkSession) -> str:
    return "/".join([f"{folder(spark)}/quernel/{spark.sparkContext.applicationId}", *_scopes])


def _remove(spark: SparkSession, path: str) -> None:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def clear(spark: SparkSession) -> None:
    """Remove what this application has stashed; until then it stays, since results read from it."""
    _remove(spark, f"{folder(spark)}/quernel/{spark.sparkContext.applicationId}")


@contextlib.contextmanager
def scope(spark: SparkSession):
    """What is stashed within goes at the end: write results before, for they read from it.

    ``with store.scope(spark): corpus_pipeline.run(spark, path).write.parquet(out)``
    """
    _scopes.append(uuid.uuid4().hex)
    path = _own(spark)
    try:
        yield
    finally:
        _scopes.pop()
        _remove(spark, path)


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage: a lost executor costs the tasks it ran and never what was
    written.  Spark's commit protocol keeps the files of one attempt per task.
    """
    path = f"{_own(df.sparkSession)}/{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give executors this package, which they may not have installed, and bound what one Arrow batch holds."""
    context = spark.sparkContext
    bound = spark.conf.get(_BATCH_KEY).lower().rstrip("b")
    if bound.lstrip("-").isdigit() and not 0 < int(bound) <= BATCH:
        spark.conf.set(_BATCH_KEY, str(BATCH))
    if getattr(context, "_quernel_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():
        target = Path(tempfile.mkdtemp(prefix="quernel"), "quernel_code.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(target))
    context._quernel_shipped = True


def trim() -> None:
    """Hand freed memory back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def mapped(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch; empty batches are skipped."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = each(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out
        trim()

    return df.mapInArrow(run, schema)

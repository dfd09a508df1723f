"""Tables that a plan reads more than once, written to the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; one is set only where none is, and only on a local master, whose executors share the machine's folders."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = Path(tempfile.gettempdir(), f"quernel-{os.getuid()}").as_uri()
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def clear(spark: SparkSession) -> None:
    """Remove what this session's queries have settled; tables read from it can't be read again after that."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/quernel/{_own(spark)}")
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def _own(spark: SparkSession) -> str:
    return spark.sparkContext.applicationId


def ship(spark: SparkSession) -> None:
    """Give executors this package, which they may not have installed."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if root.is_dir() and not getattr(context, "_quernel_shipped", False):
        target = Path(tempfile.mkdtemp(prefix="quernel"), "quernel_code.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(target))
        context._quernel_shipped = True


def settle(df: DataFrame, tag: str = "table") -> DataFrame:
    """``df``, written once as Parquet and read back, so that later passes and lost executors don't repeat its plan."""
    path = f"{folder(df.sparkSession)}/quernel/{_own(df.sparkSession)}/{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

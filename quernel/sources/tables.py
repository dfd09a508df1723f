"""Numeric columns from arrays, pandas, Arrow and DuckDB, as DataFrames of one column x."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_array(spark: SparkSession, values, partitions: int | None = None) -> DataFrame:
    """A list or array, flattened."""
    out = spark.createDataFrame(pd.DataFrame({"x": np.asarray(values, float).ravel()}))
    return out.repartition(partitions) if partitions else out


def from_arrow(spark: SparkSession, table, column: str) -> DataFrame:
    """A pyarrow Table, RecordBatch, RecordBatchReader (read once) or anything with ``__arrow_c_stream__``."""
    if isinstance(table, pa.RecordBatch):
        table = pa.Table.from_batches([table])
    elif isinstance(table, pa.RecordBatchReader):
        table = table.read_all()
    elif not isinstance(table, pa.Table):
        table = pa.RecordBatchReader.from_stream(table).read_all()
    if table.schema.names.count(column) != 1:
        raise ValueError(f"{column} must be there exactly once")
    return spark.createDataFrame(table.select([column])).select(F.col(column).cast("double").alias("x"))


def from_duckdb(spark: SparkSession, connection, sql: str, column: str) -> DataFrame:
    """A query's column; only that column leaves DuckDB."""
    quoted = '"' + column.replace('"', '""') + '"'
    found = connection.sql(f"select {quoted} from ({sql})").to_arrow_table()
    return from_arrow(spark, found, column)


def from_sql(spark: SparkSession, sql: str, column: str) -> DataFrame:
    """A column of a Spark query."""
    return spark.sql(sql).select(F.col(column).cast("double").alias("x"))

"""Columns from .npy files, Arrow IPC files and DuckDB databases, read by executors in slices; the driver sees headers only.

Each is a Spark data source with partitions, so a file of any size is many tasks and nothing of it passes through the driver.  Files have to
lie in a folder that the driver and all executors see under one path; a lost executor's slices are read again.
Nulls stay null in Arrow and DuckDB columns; what is no number is an error of the file, found before anything is read.
"""

from __future__ import annotations

import glob
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS_EACH, BATCH = 1 << 22, 1 << 16


@dataclass
class Slice(InputPartition):
    """Rows (or record batches) start to stop of a file."""

    path: str
    start: int
    stop: int


def _slices(path: str, n: int, each: int) -> list[Slice]:
    return [Slice(path, a, min(a + each, n)) for a in range(0, n, each)]


def _paths(option: str) -> list[str]:
    found = sorted(p for part in option.split("\n") for p in (glob.glob(part) if glob.has_magic(part) else [part]))
    if not found:
        raise FileNotFoundError(option)
    return found


def _numbers(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(values, np.float64))], ["x"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.each = _paths(options["path"]), int(options.get("rowsEach", ROWS_EACH))
        self.column, self.table = options.get("column", ""), options.get("table", "")


class NpyReader(_Reader):
    """One-dimensional arrays, or others in the order they are stored in."""

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for p in self.paths:
            a = np.load(p, mmap_mode="r")  # its header
            if a.dtype.kind not in "biuf":
                raise ValueError(f"{p} holds {a.dtype}, not numbers")
            out += _slices(p, a.size, self.each)
        return out

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no rows
            return
        a = np.load(partition.path, mmap_mode="r")
        flat = a.reshape(-1, order="F" if a.flags.f_contiguous and not a.flags.c_contiguous else "C")
        for i in range(partition.start, partition.stop, BATCH):
            yield _numbers(flat[i : min(i + BATCH, partition.stop)])


class ArrowReader(_Reader):
    """A column of Arrow IPC files, a task for each few record batches."""

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for p in self.paths:
            with pa.memory_map(p) as source:
                file = pa.ipc.open_file(source)
                if file.schema.names.count(self.column) != 1:
                    raise ValueError(f"{self.column} must be there exactly once in {p}")
                kind = file.schema.field(self.column).type
                if not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_decimal(kind)):
                    raise ValueError(f"{self.column} of {p} holds {kind}, not numbers")
                n = file.num_record_batches
                rows = file.get_batch(0).num_rows if n else 1
                out += _slices(p, n, max(1, self.each // max(1, rows)))
        return out

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no rows
            return
        with pa.memory_map(partition.path) as source:
            file = pa.ipc.open_file(source)
            for i in range(partition.start, partition.stop):
                batch = file.get_batch(i)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(self.column)).cast(pa.float64())], ["x"])


class DuckReader(_Reader):
    """A column of a table in a DuckDB database, or of a Parquet file through DuckDB (without ``table``), by row ranges."""

    def _source(self, path: str) -> tuple[str, str, str]:
        if self.table:
            return path, '"' + self.table.replace('"', '""') + '"', "rowid"
        quoted = path.replace("'", "''")
        return ":memory:", f"read_parquet('{quoted}', file_row_number = true)", "file_row_number"

    def _connect(self, database: str):
        import duckdb

        out = duckdb.connect(database, read_only=database != ":memory:")
        out.execute("set threads = 1")
        return out

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for p in self.paths:
            database, source, place = self._source(p)
            with self._connect(database) as c:
                # Row numbers of a table may have gaps where rows were deleted.
                out += _slices(p, c.sql(f"select coalesce(max({place}) + 1, 0) from {source}").fetchall()[0][0], self.each)
        return out

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no rows
            return
        database, source, place = self._source(partition.path)
        column = '"' + self.column.replace('"', '""') + '"'
        with self._connect(database) as c:
            found = c.sql(f"select {column}::double as x from {source} where {place} >= {partition.start} and {place} < {partition.stop}")
            yield from found.to_arrow_reader(BATCH)


def _source(kind: str, reader: type[_Reader]) -> type[DataSource]:
    class Columns(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return "x double"

        def reader(self, schema) -> DataSourceReader:
            return reader(self.options)

    return Columns


def _read(spark: SparkSession, kind: str, reader: type[_Reader], paths: str | Path | Sequence, **options) -> DataFrame:
    spark.dataSource.register(_source(kind, reader))
    several = [paths] if isinstance(paths, (str, Path)) else paths
    return spark.read.format(kind).options(**{k: str(v) for k, v in options.items()}, path="\n".join(map(str, several))).load()


def read_npy(spark: SparkSession, paths: str | Path | Sequence, rows_each: int = ROWS_EACH) -> DataFrame:
    """(x) of .npy files."""
    return _read(spark, "quernel_npy", NpyReader, paths, rowsEach=rows_each)


def read_arrow(spark: SparkSession, paths: str | Path | Sequence, column: str, rows_each: int = ROWS_EACH) -> DataFrame:
    """(x) of a column of Arrow IPC files."""
    return _read(spark, "quernel_arrow", ArrowReader, paths, column=column, rowsEach=rows_each)


def read_duckdb(spark: SparkSession, paths: str | Path | Sequence, column: str, table: str = "", rows_each: int = ROWS_EACH) -> DataFrame:
    """(x) of a column of a table of DuckDB databases, or of Parquet files where no table is named."""
    return _read(spark, "quernel_duckdb", DuckReader, paths, column=column, table=table, rowsEach=rows_each)

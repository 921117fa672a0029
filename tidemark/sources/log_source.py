"""Fixed-record logs as a Spark data source, in ranges of records.

    spark.dataSource.register(RecordLogSource)
    record_log(spark, "/mnt/logs/*.bin", schema, start=..., end=...)

A file of any size is read in ranges of ``rows_per_task`` records, each by a seek, so
no task holds a whole log.  With time bounds, a range whose first and last record
show that it lies outside is never read; a range in which the log wraps around (its
last record is older than its first) always is.  The path must be mounted on every
node; for other stores ``read_logs`` reads whole files through Spark.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.errors import SchemaError
from tidemark.operators import range_scan
from tidemark.schema import LOG_HEADER_BYTES, Field, Kind, SeriesSchema
from tidemark.sources.log import RECORDS_A_BATCH, as_column, check_header, record_type

ROWS_PER_TASK = 1_000_000


def _schema_of(options: dict[str, str]) -> SeriesSchema:
    fields = (x.split(":") for x in options["fields"].split(","))
    return SeriesSchema(tuple(Field(n, Kind[k]) for n, k in fields), options.get("time", "timestamp"))


class _Range(InputPartition):
    def __init__(self, path: str, first: int, rows: int):
        self.path, self.first, self.rows = path, first, rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self._schema = _schema_of(options)
        self._paths = options["path"]
        self._header = int(options.get("header_bytes", LOG_HEADER_BYTES))
        self._expected = bytes.fromhex(options["header"]) if "header" in options else None
        self._rows = int(options.get("rows_per_task", ROWS_PER_TASK))
        self._start, self._end = (int(options[x]) if x in options else None for x in ("start", "end"))

    def _read(self, path: str, first: int, rows: int) -> np.ndarray:
        kind = record_type(self._schema)
        with open(path, "rb") as file:
            file.seek(self._header + first * kind.itemsize)
            return np.frombuffer(file.read(rows * kind.itemsize), kind)

    def _outside(self, path: str, first: int, rows: int) -> bool:
        if self._start is None or self._end is None:
            return False
        a, b = (int(self._read(path, i, 1)[0][self._schema.time]) for i in (first, first + rows - 1))
        return a <= b and (b < self._start or a >= self._end)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in sorted(glob.glob(self._paths)):
            size = os.path.getsize(path) - self._header
            if size < 0 or size % self._schema.record_bytes:
                raise SchemaError(f"{path}: {size} bytes of records of {self._schema.record_bytes}")
            if self._expected is not None:
                with open(path, "rb") as file:
                    check_header(file.read(self._header), self._expected)
            total = size // self._schema.record_bytes
            for first in range(0, total, self._rows):
                rows = min(self._rows, total - first)
                if not self._outside(path, first, rows):
                    out.append(_Range(path, first, rows))
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        name, names = Path(partition.path).stem, ["series", *self._schema.names]
        for at in range(0, partition.rows, RECORDS_A_BATCH):
            part = self._read(partition.path, partition.first + at, min(RECORDS_A_BATCH, partition.rows - at))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), *(as_column(f.kind, part[f.name]) for f in self._schema.fields)], names=names)


class RecordLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_log"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("series", T.StringType()), *_schema_of(self.options).spark().fields])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def record_log(spark: SparkSession, path: str, schema: SeriesSchema, *, start: int | None = None, end: int | None = None, header: bytes | None = None, header_bytes: int = LOG_HEADER_BYTES, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows of all logs that a pattern names, of ``start <= time < end`` if bounds are given.

    ``header``: what each log has to begin with, as of ``header_of``.
    """
    spark.dataSource.register(RecordLogSource)
    options = {"fields": ",".join(f"{f.name}:{f.kind.name}" for f in schema.fields), "time": schema.time, "header_bytes": header_bytes, "rows_per_task": rows_per_task}
    if header is not None:
        options["header"] = header.hex()
    if start is not None and end is not None:
        options |= {"start": start, "end": end}
    df = spark.read.format("record_log").options(**options).load(path)
    return df if start is None or end is None else range_scan(df, schema.time, start, end)

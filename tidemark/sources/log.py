"""Fixed-record logs: a header, then packed little-endian records.

A log is one series and its file's name is the series' name.  The header is a mark
and a digest of the schema; readers check it, unless they are told to take any.
Records may have wrapped around at the file's budget: the record after the newest one
is then the oldest.  Time order is what readers of rows see; ``ring_state`` finds where
a writer would go on.  Strings take 128 bytes, padded with zeros.  Files are read
through Spark, from whatever store it reaches, one file a task.

Defined cases: a log without records gives no rows, and has no last time; nulls and
values out of range can't be written and raise; a series with a null name is a log of
its own; an empty table gives no logs; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import SchemaError
from tidemark.operators import places
from tidemark.schema import LOG_HEADER_BYTES, STRING_BYTES, Kind, SeriesSchema
from tidemark.storage import fresh

RECORDS_A_BATCH = 100_000
MARK = b"TIDE"


def header_of(schema: SeriesSchema, mark: bytes = MARK) -> bytes:
    """What a log of the schema begins with: a mark of four bytes, and a digest of names, types and time."""
    said = repr(([(f.name, f.kind.name) for f in schema.fields], schema.time)).encode()
    return mark + hashlib.blake2b(said, digest_size=LOG_HEADER_BYTES - len(mark)).digest()


def check_header(found: bytes, header: bytes | None) -> None:
    """Raise unless a log begins with the header; None: with any."""
    if header is None:
        return
    if len(found) < len(header):
        raise SchemaError(f"a log of {len(found)} bytes has no header")
    if found[:4] != header[:4]:
        raise SchemaError("no log: it begins with another mark")
    if found[: len(header)] != header:
        raise SchemaError("a log of another schema")


def record_type(schema: SeriesSchema) -> np.dtype:
    """The packed record."""
    return np.dtype([(f.name, f.kind.numpy) for f in schema.fields])


def as_column(kind: Kind, values: np.ndarray) -> pa.Array:
    """A field's values as Arrow."""
    if kind is Kind.STRING:
        return pa.array([v.decode("utf-8", "replace") for v in values.tolist()], pa.string())
    if kind is Kind.U64:
        return pa.array([Decimal(v) for v in values.tolist()], pa.decimal128(20, 0))
    if kind is Kind.U8:
        return pa.array(values.astype(np.int16))
    return pa.array(np.ascontiguousarray(values))


def decode_log(data: bytes, schema: SeriesSchema, header: bytes | None = None, header_bytes: int = LOG_HEADER_BYTES) -> np.ndarray:
    """A log's records, as they lie; a torn or foreign file raises."""
    check_header(data, header)
    if len(data) < header_bytes:
        raise SchemaError("no log with such a header")
    if (len(data) - header_bytes) % schema.record_bytes:
        raise SchemaError(f"{len(data) - header_bytes} bytes aren't a multiple of {schema.record_bytes}")
    return np.frombuffer(data, record_type(schema), offset=header_bytes)


def decode_logs(files: DataFrame, schema: SeriesSchema, *, header: bytes | None = None, header_bytes: int = LOG_HEADER_BYTES) -> DataFrame:
    """``files(series, content)`` as rows, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("series").to_pylist(), batch.column("content"), strict=True):
                records = decode_log(content.as_py(), schema, header, header_bytes)
                for at in range(0, len(records), RECORDS_A_BATCH):
                    part = records[at : at + RECORDS_A_BATCH]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), *(as_column(f.kind, part[f.name]) for f in schema.fields)], names=["series", *schema.names])

    return files.select("series", "content").mapInArrow(run, T.StructType([T.StructField("series", T.StringType()), *schema.spark().fields]))


def ring_state(files: DataFrame, schema: SeriesSchema, capacity: int, *, header: bytes | None = None, header_bytes: int = LOG_HEADER_BYTES) -> DataFrame:
    """``(series, records, last, cursor, wrapped)`` of each log: where its writer goes on.

    Of a log with room, after its last record.  Of a full one, after the first record
    that is newer than the one behind it; without such a descent, at the start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("series").to_pylist(), batch.column("content"), strict=True):
                times = decode_log(content.as_py(), schema, header, header_bytes)[schema.time]
                n, cursor, full = len(times), len(times), len(times) >= capacity
                last = int(times[-1]) if n else None
                if full:
                    falls = np.flatnonzero(times[1:] < times[:-1])
                    cursor = int(falls[0]) + 1 if len(falls) else 0
                    last = int(times[cursor - 1])
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([n], pa.int64()), pa.array([last], pa.int64()), pa.array([cursor], pa.int64()), pa.array([bool(full and cursor)], pa.bool_())], names=["series", "records", "last", "cursor", "wrapped"])

    return files.select("series", "content").mapInArrow(run, "series string, records long, last long, cursor long, wrapped boolean")


def read_logs(spark: SparkSession, path: str, schema: SeriesSchema, *, header: bytes | None = None, header_bytes: int = LOG_HEADER_BYTES) -> DataFrame:
    """All logs under a path; ``series`` is the file's name without its ending."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return decode_logs(files.select(name.alias("series"), "content"), schema, header=header, header_bytes=header_bytes)


def encode_records(columns: dict[str, pa.ChunkedArray], schema: SeriesSchema) -> bytes:
    """Columns as packed records."""
    out = np.zeros(len(columns[schema.time]), record_type(schema))
    for f in schema.fields:
        column = columns[f.name]
        if column.null_count:
            raise SchemaError(f"{f.name}: null")
        if f.kind is Kind.STRING:
            values = [v.encode() for v in column.to_pylist()]
            if any(len(v) > STRING_BYTES for v in values):
                raise SchemaError(f"{f.name}: over {STRING_BYTES} bytes")
            out[f.name] = values
        elif f.kind in (Kind.U64, Kind.U8):
            values = [int(v) for v in column.to_pylist()] if pa.types.is_decimal(column.type) else column.to_numpy()
            if any(not 0 <= v < 2 ** (8 * f.kind.width) for v in values):
                raise SchemaError(f"{f.name}: out of range")
            out[f.name] = values
        else:
            out[f.name] = column.to_numpy()
    return out.tobytes()


def encode_logs(df: DataFrame, schema: SeriesSchema, key: str, header: bytes | None = None, *, capacity: int | None = None, part_records: int = RECORDS_A_BATCH) -> DataFrame:
    """``(series, part, content)``: each series' records in parts of ``part_records``; the first has the header.

    ``capacity``: the newest so many records, where a writer that wraps around there
    would have put them.  Rows are dealt by series and part, so a series of any length
    is written by many tasks.
    """
    start = header_of(schema) if header is None else header
    slim = df.select(F.col(key).cast("string").alias(key), *(n for n in schema.names if n != key))
    place, count, spot, part = fresh(slim, "_at", "_all", "_slot", "_of")
    placed = places(slim, [key], schema.time, place)
    if capacity is None:
        placed = placed.withColumn(spot, F.col(place))
    else:
        [same] = fresh(placed, "_same")
        counts = placed.groupBy(F.col(key).alias(same)).agg(F.count(F.lit(1)).alias(count))
        placed = placed.join(counts, F.col(key).eqNullSafe(F.col(same))).where(F.col(place) >= F.col(count) - capacity).withColumn(spot, F.col(place) % capacity)
    dealt = placed.withColumn(part, F.floor(F.col(spot) / part_records).cast("int")).select(part, spot, *slim.columns)
    dealt = dealt.repartition(F.col(key), F.col(part)).sortWithinPartitions(key, part, spot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def emit() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            content = (start if now[1] == 0 else b"") + encode_records({n: whole.column(n) for n in schema.names}, schema)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int32()), pa.array([content], pa.binary())], names=["series", "part", "content"])

        for batch in batches:
            at = 0
            for which, run in groupby(zip(batch.column(key).to_pylist(), batch.column(part).to_pylist(), strict=True)):
                if which != now:
                    if held:
                        yield emit()
                    now, held = which, []
                n = sum(1 for _ in run)
                held.append(batch.slice(at, n))
                at += n
        if held:
            yield emit()

    return dealt.mapInArrow(run, "series string, part int, content binary")


def export_log(encoded: DataFrame, series: str, path: str) -> int:
    """One series' parts to a local file, a part at a time; returns the bytes written."""
    total = 0
    with open(path, "wb") as out:
        for row in encoded.where(F.col("series") == series).orderBy("part").select("content").toLocalIterator():
            total += out.write(row["content"])
    return total

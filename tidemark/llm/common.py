"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.storage import shared_folder

#: Bytes of text that a Python worker turns into strings at a time; a longer text goes alone.
SLICE_BYTES = 4 << 20
#: Rows of a few numbers that make a file.
ROWS_A_FILE = 250_000
#: Rows with a signature, and rows that a task has to work on.
WIDE_ROWS, HEAVY_ROWS = 8_000, 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fewer(df: DataFrame, rows: int, a_file: int = ROWS_A_FILE) -> DataFrame:
    """A table of at most ``rows`` rows in partitions of about ``a_file``, if it comes in more of them."""
    files = max(1, -(-rows // a_file))
    return df.coalesce(files) if files < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def durable(df: DataFrame, rows: int | None = None, a_file: int = ROWS_A_FILE) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    ``rows``: a bound on the rows, if one is known; a small table then goes into few
    files, however many partitions it comes in.
    """
    shared_folder(df.sparkSession)
    return (df if rows is None else fewer(df, rows, a_file)).checkpoint(eager=True)


class Memo(dict):
    """A dict that computes missing values and forgets everything at its bound."""

    def __init__(self, make: Callable, bound: int = 100_000):
        super().__init__()
        self._make, self._bound = make, bound

    def __missing__(self, key):
        if len(self) >= self._bound:
            self.clear()
        value = self[key] = self._make(key)
        return value


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The column as Python strings; null is the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def _tidy() -> None:
    """Give what a task has freed back to the system: a Python worker outlives its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def bounded(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` bytes of a column, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
        del batch
    _tidy()


def map_rows(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` with one output batch, or none, for each input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def column_names_like(df: DataFrame, wanted: list[str]) -> list[str]:
    """``wanted``, each made different from every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    return [reduce(lambda n, _: n + "_" if n.lower() in taken else n, range(len(taken)), w) for w in wanted]


def with_text(df: DataFrame, text: str, change: Callable[[list[str]], list[str]], length: str = "n_chars") -> DataFrame:
    """``df`` with new texts and, where that column exists, new lengths; null stays null."""
    schema = arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text):
            old = batch.column(text).to_pylist()
            given = [i for i, t in enumerate(old) if t is not None]
            new = list(old)
            for i, t in zip(given, change([old[i] for i in given]), strict=True):
                new[i] = t
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns[text] = pa.array(new, pa.string())
            if length in columns:
                was = batch.column(length).to_pylist()
                lengths = [w if t is None or t == o else len(t) for w, t, o in zip(was, new, old, strict=True)]
                columns[length] = pa.array(lengths, schema.field(length).type)
            yield pa.RecordBatch.from_arrays([columns[n].cast(schema.field(n).type) for n in schema.names], schema=schema)

    return df.mapInArrow(run, df.schema)


def crc_of_id(name: str):
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(name).cast("string"))


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def struct_of(text: str) -> T.StructType:
    """``"a long, b string[]"`` as a schema; needs no session, so modules can hold it."""
    fields = []
    for part in text.split(","):
        name, kind = part.split()
        many = kind.endswith("[]")
        base = _KINDS[kind.removesuffix("[]")]
        fields.append(T.StructField(name, T.ArrayType(base) if many else base))
    return T.StructType(fields)

"""Series in a Parquet table, partitioned by the series' key."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.errors import NotMonotonic, SchemaError, StoreLocked
from tidemark.operators import admit_monotonic_split, assign_sequence_split, rejects_split
from tidemark.schema import SeriesSchema
from tidemark.series import Series, bound_of, require_room
from tidemark.storage import durable

#: Rows of a series that go into one file, about.
FILE_ROWS = 2_000_000


class SeriesStore:
    """A folder of series with one schema that never changes.

    Rows are sorted by time inside each file, so row-group statistics are narrow and
    a time range reads little.  An append holds a lock, a file beside the table that
    only one writer can create: a second writer raises at once, and never reads a last
    time that the first is about to change.  A bound is a number of rows or a byte
    budget of records; a store that stops when full raises before it writes anything.
    """

    def __init__(self, spark: SparkSession, path: str, schema: SeriesSchema, key: str = "series", *, keep: int | None = None, max_bytes: int | None = None, stop_when_full: bool = False):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        self.keep, self.stop_when_full = bound_of(schema, keep, max_bytes), stop_when_full
        stored = self._stored()
        if stored is not None:
            columns = [f for f in stored.schema if f.name != key]
            try:
                found = SeriesSchema.from_spark(type(stored.schema)(columns), schema.time)
            except SchemaError as error:
                raise SchemaError(f"the stored table is of another kind: {error}") from error
            schema.require_same(found)

    def _file(self, path: str):
        """(file system, path) of the JVM."""
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), found

    @property
    def lock_path(self) -> str:
        return f"{self.path.rstrip('/')}.lock"

    @contextlib.contextmanager
    def writing(self) -> Iterator[None]:
        """Hold the store's lock."""
        files, lock = self._file(self.lock_path)
        try:
            files.create(lock, False).close()
        except Py4JJavaError as error:
            if files.exists(lock):
                raise StoreLocked(f"another writer holds {self.path}; if it has died, call break_lock()") from error
            raise
        try:
            yield
        finally:
            files.delete(lock, False)

    def break_lock(self) -> None:
        """Remove the lock of a writer that has died."""
        files, lock = self._file(self.lock_path)
        files.delete(lock, False)

    def _stored(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException:
            return None

    def rows(self) -> DataFrame:
        stored = self._stored()
        if stored is None:
            empty = self.schema.spark().add(self.key, "string")
            return self.spark.createDataFrame([], empty)
        return stored.withColumn(self.key, F.col(self.key).cast("string"))

    def series(self, name: str | None = None) -> Series:
        """All series, or one of them: its partition alone is read."""
        df = self.rows()
        if name is None:
            return Series(df, self.schema, [self.key], keep=self.keep, stop_when_full=self.stop_when_full)
        return Series(df.where(F.col(self.key) == name), self.schema, [], keep=self.keep, stop_when_full=self.stop_when_full)

    def _write(self, rows: DataFrame, target: str | None = None, mode: str = "append") -> None:
        """Files of about ``FILE_ROWS`` rows, however many a series has; sorted by series and time."""
        dealt = rows.select(self.key, *self.schema.names).repartitionByRange(max(1, -(-rows.count() // FILE_ROWS)), self.key, self.schema.time)
        dealt.sortWithinPartitions(self.key, self.schema.time).write.mode(mode).partitionBy(self.key).parquet(target or self.path)

    def _take(self, rows: DataFrame, stored: DataFrame) -> None:
        rows = durable(rows)  # counted, checked and written, but computed once
        if self.keep is not None and self.stop_when_full:
            require_room(stored.select(self.key).unionByName(rows.select(self.key)), [self.key], self.keep)
        self._write(rows)

    def append(self, batch: DataFrame, arrival: str, *, on_reject: str = "drop") -> None:
        """Admit a batch by arrival; see ``Series.append``."""
        rows = self.schema.conform(batch)
        with self.writing():
            stored = self.rows()
            if on_reject == "raise" and not rejects_split(rows, [self.key], arrival, self.schema.time, stored).isEmpty():
                raise NotMonotonic("times of the batch don't strictly increase")
            self._take(admit_monotonic_split(rows, [self.key], arrival, self.schema.time, stored), stored)

    def append_numbered(self, batch: DataFrame, arrival: str) -> None:
        with self.writing():
            stored = self.rows()
            self._take(assign_sequence_split(self.schema.conform(batch), [self.key], arrival, self.schema.time, stored), stored)

    def compact(self, target: str) -> None:
        """What the bound keeps, written to another folder."""
        self._write(self.series().df, target, "overwrite")

    def drop(self) -> None:
        """Remove the folder, through Spark's file system; not under a writer's hands."""
        with self.writing():
            files, path = self._file(self.path)
            files.delete(path, True)

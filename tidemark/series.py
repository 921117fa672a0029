"""A collection of keyed series over one DataFrame."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import EmptySeries, NotMonotonic, SchemaError, SeriesFull
from tidemark.functions import as_number, conjunction, latest, statistics
from tidemark.operators import admit_monotonic_split, assign_sequence_split, frames, in_order, multi_range, range_scan, rejects_split, retain_newest, retain_oldest
from tidemark.schema import SeriesSchema
from tidemark.storage import fresh


def bound_of(schema: SeriesSchema, keep: int | None, max_bytes: int | None) -> int | None:
    """Rows that a series keeps, from a number or a byte budget; both: the smaller."""
    held = [n for n in (keep, None if max_bytes is None else schema.capacity(max_bytes)) if n is not None]
    return min(held, default=None)


def require_room(rows: DataFrame, keys: list[str], keep: int) -> None:
    """Raise if a series has more than ``keep`` rows."""
    [n] = fresh(rows, "_rows")
    over = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > keep).first()
    if over is not None:
        raise SeriesFull(f"a series holds {keep} rows, not {over[n]}: {[over[k] for k in keys]}")


class Series:
    """Series of one schema, told apart by key columns; without keys there is one.

    ``keep``, or the records that ``max_bytes`` hold, bound each series to its newest
    rows; with ``stop_when_full`` to its first ones, and then an append that doesn't
    fit raises and adds nothing.
    """

    def __init__(self, df: DataFrame, schema: SeriesSchema, keys: list[str] | None = None, *, keep: int | None = None, max_bytes: int | None = None, stop_when_full: bool = False):
        self.keys = list(keys or [])
        missing = [c for c in [*self.keys, *schema.names] if c not in df.columns]
        if missing:
            raise SchemaError(f"missing columns: {missing}")
        keep = bound_of(schema, keep, max_bytes)
        if keep is not None and keep < 1:
            raise SchemaError("a series keeps at least one row")
        self.schema, self.keep, self.stop_when_full = schema, keep, stop_when_full
        bound = df
        if keep is not None:
            bound = (retain_oldest if stop_when_full else retain_newest)(df, self.keys, schema.time, keep)
        self.df = bound

    def _like(self, df: DataFrame) -> Series:
        return Series(df, self.schema, self.keys)

    def load(self) -> DataFrame:
        """All rows in time order."""
        return in_order(self.df, self.schema.time, self.keys)

    def range(self, start: int, end: int) -> Series:
        """Rows with ``start <= time < end``."""
        return self._like(range_scan(self.df, self.schema.time, start, end))

    def where(self, predicate: Column | None = None, **values: Any) -> Series:
        """Rows that equal all values, by schema-checked literals, and fulfil the predicate."""
        df = self.df.where(conjunction(self.schema, **values))
        return self._like(df if predicate is None else df.where(predicate))

    def query(self, start: int, end: int, filters: dict[str, Any] | list[dict[str, Any]] | None = None) -> DataFrame:
        """A range with equality filters, in time order."""
        parts = filters if isinstance(filters, list) else [filters or {}]
        merged: list[Column] = [conjunction(self.schema, **p) for p in parts]
        found = self.range(start, end).df
        for c in merged:
            found = found.where(c)
        return in_order(found, self.schema.time, self.keys)

    def stats(self, field: str | int, start: int | None = None, end: int | None = None) -> DataFrame:
        """min, max, sum, count and mean of a field, by name or index, for each series or, without keys, in one row."""
        value = as_number(self.schema, self.schema.resolve(field))  # an unknown field fails even for an empty range
        df = self.df if start is None or end is None else range_scan(self.df, self.schema.time, start, end)
        return df.groupBy(*self.keys).agg(*statistics(value)) if self.keys else df.agg(*statistics(value))

    def latest(self, field: str | int) -> DataFrame:
        """value and timestamp of the newest row of each series."""
        found = latest(self.schema, self.schema.resolve(field))
        return self.df.groupBy(*self.keys).agg(*found) if self.keys else self.df.agg(*found).where(F.col("timestamp").isNotNull())

    def latest_value(self, field: str | int) -> tuple[float, int]:
        """The newest value of a single series; an empty one raises."""
        found = latest(self.schema, self.schema.resolve(field))
        row = self.df.agg(*found).first()
        if row["timestamp"] is None:
            raise EmptySeries("no rows")
        return row["value"], row["timestamp"]

    def count(self) -> int:
        return self.df.count()

    def counts(self) -> DataFrame:
        return self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("rows"))

    def position(self, name: str) -> int:
        return self.schema.position(name)

    def frames(self, sums: str, means: str, rows: int = 1_000) -> DataFrame:
        return frames(self.df, self.keys, self.schema.time, sums, means, rows)

    def ranges(self, ranges: DataFrame, width: int, **names: str) -> DataFrame:
        return multi_range(self.df, ranges, self.keys, self.schema.time, width, **names)

    def append(self, batch: DataFrame, arrival: str, *, on_reject: str = "drop") -> Series:
        """The series with a batch in order of arrival; times must strictly increase.

        ``on_reject``: "drop" leaves bad rows out, "raise" fails on the first one.
        """
        rows = self.schema.conform(batch)
        if on_reject == "raise" and not rejects_split(rows, self.keys, arrival, self.schema.time, self.df).isEmpty():
            raise NotMonotonic("times of the batch don't strictly increase")
        return self._grown(admit_monotonic_split(rows, self.keys, arrival, self.schema.time, self.df))

    def append_numbered(self, batch: DataFrame, arrival: str) -> Series:
        """As ``append``, with times assigned after the stored ones."""
        return self._grown(assign_sequence_split(self.schema.conform(batch), self.keys, arrival, self.schema.time, self.df))

    def _grown(self, rows: DataFrame) -> Series:
        both = self.df.select(*self.keys, *self.schema.names).unionByName(rows.select(*self.keys, *self.schema.names))
        if self.stop_when_full and self.keep is not None:
            require_room(both, self.keys, self.keep)
        return Series(both, self.schema, self.keys, keep=self.keep, stop_when_full=self.stop_when_full)

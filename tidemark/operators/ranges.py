"""Many ranges at once, lower bounds and a sparse time index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.split import places
from tidemark.storage import fresh


def multi_range(df: DataFrame, ranges: DataFrame, keys: list[str], time: str, width: int, *, start: str = "range_start", end: str = "range_end") -> DataFrame:
    """Rows of ``df`` joined with every range that holds them, ``start <= time < end``.

    ``time`` is an integer.  Each range is listed under the buckets of ``width`` that
    it touches, and rows meet ranges by an equi-join on the bucket with the bounds as
    a residual; there is no nested-loop join, and the engine chooses to broadcast the
    ranges by their size.  A width near the ranges' own gives two or three buckets.
    Rows and ranges with a null key, time or bound meet nothing; ranges that repeat
    each get their rows.
    """
    bucket = F.floor(F.col(time) / width)
    touched = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    # a name that is free in both tables
    [name] = fresh(df, "_bucket")
    [name] = fresh(ranges, name)
    listed = ranges.where(F.col(start) < F.col(end)).withColumn(name, F.explode(touched))
    joined = df.withColumn(name, bucket).join(listed, [*keys, name])
    return joined.where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop(name)


def lower_bounds(df: DataFrame, keys: list[str], time: str, targets: list) -> DataFrame:
    """For each target, how many rows of each series come before it: the place of the first row at or after it."""
    counts = [F.count_if(F.col(time) < t).alias(f"t{i}") for i, t in enumerate(targets)]
    return df.groupBy(*keys).agg(*counts)


def fence_index(df: DataFrame, keys: list[str], time: str, stride: int = 1024) -> DataFrame:
    """(keys, time, place) of every ``stride``-th row in time order, from place 0; no task counts a whole series."""
    return places(df.select(*keys, time), keys, time, "place").where(F.col("place") % stride == 0)

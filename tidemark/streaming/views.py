"""Running aggregates of a stream; use output mode complete or update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import as_number, latest, statistics
from tidemark.schema import SeriesSchema


def running_latest(stream: DataFrame, schema: SeriesSchema, keys: list[str], name: str) -> DataFrame:
    return stream.groupBy(*keys).agg(*latest(schema, name))


def running_stats(stream: DataFrame, schema: SeriesSchema, keys: list[str], name: str) -> DataFrame:
    return stream.groupBy(*keys).agg(*statistics(as_number(schema, name)))


def windowed_stats(stream: DataFrame, schema: SeriesSchema, keys: list[str], name: str, width: str, late: str) -> DataFrame:
    """Statistics of a field for each time window of ``width``; the time counts microseconds.

    Rows that are more than ``late`` behind the newest are left out, and the state of
    windows that can no longer change is dropped.  Output mode append gives each
    window once, when it is closed; update and complete give it as it grows.
    """
    timed = stream.select("*", F.timestamp_micros(F.col(schema.time)).alias("_moment")).withWatermark("_moment", late)
    found = timed.groupBy(F.window("_moment", width).alias("_window"), *keys).agg(*statistics(as_number(schema, name)))
    return found.select(F.unix_micros("_window.start").alias("window_start"), *keys, "min", "max", "sum", "count", "mean")

"""Range scans and time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_scan(df: DataFrame, time: str, start: Column | int, end: Column | int) -> DataFrame:
    """Rows with ``start <= time < end``; bounds that cross give no rows, and no error.

    The predicate is on the raw column, so it is pushed to the scan.
    """
    return df.where((F.col(time) >= start) & (F.col(time) < end))


def in_order(df: DataFrame, time: str, keys: list[str] | None = None) -> DataFrame:
    """Rows in time order, by series if keys are given."""
    return df.orderBy(*(keys or []), time)

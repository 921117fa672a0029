"""Between integer times and timestamp columns.

Bounds are turned into literals of the raw column's type, so that they reach the
Parquet scan; a filter on a derived integer column would not.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000}
_EPOCH = datetime(1970, 1, 1)


def micros(column: str | Column, unit: str = "us") -> Column:
    """A zone-free timestamp as whole units since 1970, whatever the session's zone."""
    c = F.col(column) if isinstance(column, str) else column
    n = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), c)
    return n if unit == "us" else F.floor(n / UNITS[unit]).cast("long")


def time_literal(value: int, unit: str = "us") -> Column:
    """Whole units since 1970 as a zone-free timestamp literal."""
    return F.expr(f"timestamp_ntz'{_EPOCH + timedelta(microseconds=value * UNITS[unit])}'")

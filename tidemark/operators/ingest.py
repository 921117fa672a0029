"""Admission, sequence numbers and retention.

Windows are partitioned by the series' key; where one series holds most of the rows,
or there is no key, ``split`` has the same operators over range partitions.

Defined cases: a null key is a series of its own; rows with a null time are never ahead
once their series has a time; rows of one arrival come in any order; an empty table
gives no rows; no column of the caller's is touched, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.split import _last_stored, assign_sequence_split
from tidemark.storage import fresh


def _ahead(df: DataFrame, keys: list[str], arrival: str, time: str, stored: DataFrame | None) -> tuple[DataFrame, Column]:
    """Whether a row's time exceeds all earlier ones, stored ones included.

    A rejected row never exceeds the greatest earlier time, so the running maximum
    over all rows is that over the admitted ones.
    """
    before = Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    df, last = _last_stored(df, stored, keys, time)
    [most] = fresh(df, "_most")
    return df.withColumn(most, F.greatest(F.max(time).over(before), last)), F.col(most).isNull() | (F.col(time) > F.col(most))


def admit_monotonic(df: DataFrame, keys: list[str], arrival: str, time: str, stored: DataFrame | None = None) -> DataFrame:
    """Rows, in order of arrival, whose time is greater than every earlier one of the series."""
    marked, ok = _ahead(df, keys, arrival, time, stored)
    return marked.where(ok).select(*df.columns)


def rejects(df: DataFrame, keys: list[str], arrival: str, time: str, stored: DataFrame | None = None) -> DataFrame:
    """The rows that ``admit_monotonic`` leaves out."""
    marked, ok = _ahead(df, keys, arrival, time, stored)
    return marked.where(~ok).select(*df.columns)


def assign_sequence(df: DataFrame, keys: list[str], arrival: str, time: str, stored: DataFrame | None = None) -> DataFrame:
    """``time`` becomes 1, 2, 3 ... by arrival in each series, or goes on after the stored ones."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(arrival)).cast("long")
    joined, last = _last_stored(df, stored, keys, time)
    return joined.withColumn(time, n + F.coalesce(last, F.lit(0))).select(*df.columns)


def assign_sequence_single(df: DataFrame, arrival: str, time: str, first: int = 1) -> DataFrame:
    """One series of any length: range partitions by arrival, numbered from their counts."""
    return assign_sequence_split(df, [], arrival, time, first=first)


def _first_of(df: DataFrame, keys: list[str], order: Column, n: int) -> DataFrame:
    """The first ``n`` rows of each series; the limit is applied before the shuffle as well."""
    if not keys:
        return df.orderBy(order).limit(n)
    [rank] = fresh(df, "_rank")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col(rank) <= n).drop(rank)


def retain_newest(df: DataFrame, keys: list[str], time: str, n: int) -> DataFrame:
    """The newest ``n`` rows of each series."""
    return _first_of(df, keys, F.desc(time), n)


def retain_oldest(df: DataFrame, keys: list[str], arrival: str, n: int) -> DataFrame:
    """The first ``n`` rows of each series: what a series that stops when full has taken."""
    return _first_of(df, keys, F.asc(arrival), n)

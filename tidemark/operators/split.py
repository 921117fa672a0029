"""Admission and numbering of series of any length: one series may hold most of the rows.

Rows are dealt into range partitions by series and order, so a long series spans
several tasks.  Inside a partition a window sees its own part of a series; what the
parts before it hold (a number of rows, a greatest time) is carried over from their
totals.  Only series that span partitions have a carry, and a partition can share no
more than its first and its last series with others: the carries are at most two
rows a partition, which bounds what is broadcast.

Defined cases: a null key is a series of its own; rows with a null order come first; ties
in the order come in any order, but each row once; an empty table gives no rows; no
column of the caller's is touched, whatever its name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.storage import durable, fresh


def _with_carry(df: DataFrame, keys: list[str], order: str, total: Column, gather: Callable[[Column], Column]) -> tuple[DataFrame, str, str]:
    """``df`` in range partitions, with the gathered totals of a series' parts before this one, or null.

    Also returned: the names of the partition's and the carry's columns.  The
    partitions are checkpointed, so that totals and windows see the same ones after
    a lost executor.
    """
    part, carry, of, all_parts, *names = fresh(df, "_part", "_carry", "_of", "_parts", *(f"_key{i}" for i in range(len(keys))))
    dealt = durable(df.repartitionByRange(*keys, order).withColumn(part, F.spark_partition_id()))
    # keys by their own names here, so that a total's name can't clash with them
    same_keys = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    parts = dealt.groupBy(F.col(part).alias(of), *same_keys).agg(total.alias(carry))
    spans = parts.withColumn(all_parts, F.count(F.lit(1)).over(Window.partitionBy(*names))).where(F.col(all_parts) > 1)
    before = Window.partitionBy(*names).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    carries = spans.select(of, *names, gather(F.col(carry)).over(before).alias(carry))
    same = F.col(part) == F.col(of)
    for k, n in zip(keys, names, strict=True):
        same &= F.col(k).eqNullSafe(F.col(n))
    # at most two rows a partition
    return dealt.join(F.broadcast(carries), same, "left").drop(of, *names), part, carry


def places(df: DataFrame, keys: list[str], order: str, name: str = "place") -> DataFrame:
    """Each row's place, from 0, in the order of its series; ties come in any order."""
    placed, part, carry = _with_carry(df, keys, order, F.count(F.lit(1)), F.sum)
    n = F.row_number().over(Window.partitionBy(part, *keys).orderBy(order))
    return placed.withColumn(name, (n - 1 + F.coalesce(carry, F.lit(0))).cast("long")).drop(part, carry)


def _last_stored(df: DataFrame, stored: DataFrame | None, keys: list[str], time: str) -> tuple[DataFrame, Column]:
    """``df`` with the greatest stored time of each series, or null."""
    if stored is None:
        return df, F.lit(None).cast("long")
    if not keys:
        return df, F.lit(stored.agg(F.max(time)).first()[0])
    last, *names = fresh(df, "_last", *(f"_stored{i}" for i in range(len(keys))))
    # a row for each series, from partial maxima
    found = stored.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).agg(F.max(time).alias(last))
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same &= df[k].eqNullSafe(found[n])
    return df.join(found, same, "left").drop(*names), F.col(last)


def assign_sequence_split(df: DataFrame, keys: list[str], arrival: str, time: str, stored: DataFrame | None = None, first: int = 1) -> DataFrame:
    """As ``assign_sequence``, without a task that holds a whole series; ``first``: of a series that isn't stored."""
    [place] = fresh(df, "_place")
    placed, last = _last_stored(places(df, keys, arrival, place), stored, keys, time)
    return placed.withColumn(time, (F.col(place) + F.coalesce(last + 1, F.lit(first))).cast("long")).select(*df.columns)


def _ahead_split(df: DataFrame, keys: list[str], arrival: str, time: str, stored: DataFrame | None) -> tuple[DataFrame, Column]:
    dealt, part, carry = _with_carry(df, keys, arrival, F.max(time), F.max)
    dealt, last = _last_stored(dealt, stored, keys, time)
    own = F.max(time).over(Window.partitionBy(part, *keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    [most] = fresh(dealt, "_most")
    # greatest skips nulls: a part without earlier rows has the carry alone
    marked = dealt.withColumn(most, F.greatest(own, F.col(carry), last))
    return marked, F.col(most).isNull() | (F.col(time) > F.col(most))


def admit_monotonic_split(df: DataFrame, keys: list[str], arrival: str, time: str, stored: DataFrame | None = None) -> DataFrame:
    """As ``admit_monotonic``, without a task that holds a whole series."""
    marked, ok = _ahead_split(df, keys, arrival, time, stored)
    return marked.where(ok).select(*df.columns)


def rejects_split(df: DataFrame, keys: list[str], arrival: str, time: str, stored: DataFrame | None = None) -> DataFrame:
    """As ``rejects``, without a task that holds a whole series."""
    marked, ok = _ahead_split(df, keys, arrival, time, stored)
    return marked.where(~ok).select(*df.columns)

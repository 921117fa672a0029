"""Range statistics and latest values as aggregate expressions.

All numbers are 64-bit floats.  NaN is skipped by the least and the greatest value,
reaches the sum and the mean, and counts.  Infinities never lower the least value
above the largest finite number, nor lift the greatest below the smallest.  No rows
give zeros.  A string field has zeros with its count.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import TypeMismatch
from tidemark.schema import Kind, SeriesSchema

MAX = sys.float_info.max


def as_number(schema: SeriesSchema, name: str) -> Column:
    return F.lit(0.0) if schema.kind(name) is Kind.STRING else F.col(name).cast("double")


def statistics(value: Column) -> list[Column]:
    """min, max, sum, count and mean of a float column."""
    n = F.count(F.lit(1))
    number = F.when(~F.isnan(value), value)
    return [
        F.when(n == 0, 0.0).otherwise(F.least(F.coalesce(F.min(number), F.lit(MAX)), F.lit(MAX))).alias("min"),
        F.when(n == 0, 0.0).otherwise(F.greatest(F.coalesce(F.max(number), F.lit(-MAX)), F.lit(-MAX))).alias("max"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"),
        n.alias("count"),
        F.when(n == 0, 0.0).otherwise(F.sum(value) / n).alias("mean"),
    ]


def latest(schema: SeriesSchema, name: str) -> list[Column]:
    """value and timestamp of the row with the greatest time."""
    if schema.kind(name) is Kind.STRING:
        raise TypeMismatch(f"{name} is a string: it has no latest number")
    time = F.col(schema.time)
    return [F.max_by(as_number(schema, name), time).alias("value"), F.max(time).alias("timestamp")]

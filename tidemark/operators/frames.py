"""Frames of a fixed number of consecutive rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.split import places
from tidemark.storage import fresh

FRAME_ROWS = 1_000


def frames(df: DataFrame, keys: list[str], time: str, sums: str, means: str, rows: int = FRAME_ROWS) -> DataFrame:
    """Sum of one field, and sum and mean of another, for each complete frame of each series.

    The frame of a row follows from its place in time order, which no task counts for a
    whole series; the last, incomplete frame is dropped.  A null key is a series of its
    own; rows of one time come in any order; nulls of a field add nothing; an empty
    table gives no frames.
    """
    slim = df.select(*dict.fromkeys([*keys, time, sums, means]))
    [place] = fresh(slim, "_place")
    framed = places(slim, keys, time, place).withColumn("frame", F.floor(F.col(place) / rows).cast("long"))
    found = framed.groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("start"), F.sum(means).alias("mean_sum"), F.sum(sums).alias("sum"), F.avg(means).alias("mean"))
    return found.where(F.col("n") == rows).drop("n")


def frame_checksum(framed: DataFrame) -> DataFrame:
    """Sum over all frames of the one field's sum and the other's mean."""
    return framed.agg(F.count(F.lit(1)).alias("frames"), F.coalesce(F.sum(F.col("sum") + F.col("mean")), F.lit(0.0)).alias("checksum"))

"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable

MAX_ROUNDS = 60


def _star(edges: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # a table of its own, so that the join below reads plain shuffles and a hub's edges can be split over tasks
    least = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * n)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these."""
    least = durable(edges.groupBy("u").agg(F.min("v").alias("m")), n)
    moved = edges.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)`` that isn't its component's least node.

    The edge table shrinks towards stars; a hub only ever meets partial minima and
    joins that can be split, and the table is checkpointed after each step.  It has
    ended when each node has one edge and no root has any.  ``most``: a bound on the
    edges, if one is known.
    """
    edges = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v"), most)
    now = durable(edges.distinct(), edges.count())
    for _ in range(MAX_ROUNDS):
        row = now.agg(F.count("*").alias("n"), F.count_distinct("u").alias("nodes")).first()
        if row["n"] == row["nodes"] and now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        star = durable(_star(now, row["n"]), row["n"])
        now = durable(_small_star(star, row["n"]), row["n"])
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")

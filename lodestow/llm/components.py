"""Connected components of an edge table by alternating stars (Kiveris et al., 2014), each round a written table.

A node may have any share of the edges: its least neighbour is found on the map side and goes to its edges by a checked
broadcast, or by a join of two plain shuffles that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestow.llm.base import small, table


def _least(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of each u; counted on the map side, so a hot node costs one row a task."""
    return small(pairs.groupBy("u").agg(F.min("v").alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v): every node that has an edge and is not the smallest of its component, with that smallest node.

    edges has integer u and v, no nulls; loops are ignored. Rounds grow with the logarithm of the longest path.
    """
    now = table(edges.where("u != v").select("u", "v").distinct())
    seen = None
    for _ in range(most_rounds):
        now = table(_small_star(_large_star(now)))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now
        seen = state
    raise RuntimeError(f"components not settled after {most_rounds} rounds")

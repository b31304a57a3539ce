"""Connected components by alternating large-star and small-star (Kiveris et al., 2014), on DataFrames.

Each step is a partial-aggregated minimum for every node, which is written, and a join of the two tables. A node with very
many neighbours is a skewed key of that join; as both sides are plain shuffles and what follows is written or dealt anew by
other keys, adaptive execution splits its rows over tasks and no task has to hold them. Every step is written to shared
storage, and the step before it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm.common import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-least")
    moved = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"), "star")
    discard(least)
    return moved


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m")), "star-least")
    across = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = written(across.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "star")
    discard(least)
    return moved


def _is_stars(edges: DataFrame) -> bool:
    """True if no node has two edges to smaller nodes, or one to a smaller and one to a larger: neither step changes that."""
    leaves = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    centres = edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    ends = leaves.union(centres).groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ends.filter("down + up > 1 AND down > 0").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node with an edge of edges(u, v).

    Edges may be repeated or reversed; loops add nothing; no edges give an empty table.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "star")
    while not _is_stars(now):
        large = _large_star(now)
        discard(now)
        now = _small_star(large)
        discard(large)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(centres)

"""Connected components by alternating large-star and small-star joins.

Each round hangs every vertex on the least neighbour it knows (Kiveris et al.,
"Connected Components in MapReduce and Beyond").  Rounds are DataFrame
aggregations and joins; each is written to the shared folder, so neither edges
nor components ever reach the driver, and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): each vertex with the least vertex of its component, roots left out.

    ``edges`` has long columns u and v; loops and repeats are allowed.
    """
    current = scratch.save(edges.filter("u <> v").distinct(), "edges")
    mark = None
    while mark != (now := _mark(current)) and now[0]:
        mark = now
        large = scratch.save(_large_star(current), "large")
        scratch.drop(current)
        current = scratch.save(_small_star(large), "small")
        scratch.drop(large)
    return current

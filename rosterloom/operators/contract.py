"""Groups of linked nodes by contraction.

In each round every node moves to its least neighbour, itself included, in an order drawn
anew for the round; nodes that met become one, edges between them go, and the rest of the
graph is contracted again until no edge is left.  A random order makes the graph shrink by
a constant factor a round, chains included.  Degrees don't matter: least neighbours are an
aggregate that combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Aside


def group_nodes(nodes: DataFrame | None, edges: DataFrame, aside: Aside) -> DataFrame:
    """(node, group) of every node (long) by edges (a, b); nodes without edges are groups of their own, or left out where ``nodes`` is None."""
    edges, turns = aside.save(edges.filter("a <> b").distinct(), "edges"), []
    while not edges.isEmpty():
        turn = len(turns)
        # as they are at first, which ends stars around a least node at once; xxhash64 of one long never gives two the same place
        order = lambda c: F.xxhash64(F.lit(turn), F.col(c)) if turn else F.col(c)  # noqa: B023, E731
        ends = edges.select("a", "b").union(edges.select("b", "a")).toDF("from", "to")
        least = ends.groupBy("from").agg(F.min_by("to", order("to")).alias("to"), F.min(order("to")).alias("first"))
        moves = aside.save(least.select("from", F.when(F.col("first") < order("from"), F.col("to")).otherwise(F.col("from")).alias("to")), f"moves-{turn}")
        for end in ("a", "b"):
            edges = edges.join(moves.withColumnRenamed("from", end), end).drop(end).withColumnRenamed("to", end)
        edges = aside.save(edges.filter("a <> b").select("a", "b").distinct(), f"edges-{turn}")
        turns.append(moves)
    # from the last round, which has the fewest nodes, to the first
    found = edges.toDF("node", "group")
    for moves in reversed(turns):
        found = moves.join(found.withColumnRenamed("node", "to"), "to", "left").select(F.col("from").alias("node"), F.coalesce("group", "to").alias("group"))
    return found if nodes is None else nodes.join(found, "node", "left").select("node", F.coalesce("group", "node").alias("group"))

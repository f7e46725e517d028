"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyq.llm.common import Shelf


def components(edges: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is one node of its component.

    Each round every node goes to the smallest of itself and its neighbours,
    and the edges are rewritten to where their ends went. Nodes are hashes, so
    their order is random and a constant share of them goes in each round. A
    round is one aggregate and two joins over the edges that are left, written
    to the shared folder (with a shelf, to that); rounds end when no edge is
    left.
    """
    stored = (shelf or Shelf(edges.sparkSession)).stored
    kind = edges.schema["a"].dataType.simpleString()
    moves = []
    left = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "moves")
        moves.append(move)
        moved = (
            left.join(move.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a")
            .join(move.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
            .where("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        )
        left = stored(moved.distinct(), "edges")
    if not moves:
        return edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    roots = moves[0].select("node", F.col("to").alias("root"))
    for move in moves[1:]:
        step = move.select(F.col("node").alias("root"), F.col("to").alias("next"))
        roots = roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return roots

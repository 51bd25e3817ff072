"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelode.runtime import Scratch

#: Pointer jumps a round.
JUMPS = 2


def _distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """``node, label`` of every node of an edge between two different nodes; label is the smallest node of its component.

    * Null ends and edges from a node to itself link nothing; repeats and both
      directions of an edge count once; an empty table gives no rows.
    * Other columns are never read. Nodes must be of one orderable type.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    left = scratch.put(_distinct_edges(edges.select(F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b"))), "edges")
    labels, turn = None, 0
    while turn == 0 or not left.isEmpty():
        both = left.select(F.col("a").alias("n"), F.col("b").alias("m")).unionAll(left.select(F.col("b").alias("n"), F.col("a").alias("m")))
        parent = scratch.put(both.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("p")), f"parent{turn}")
        for k in range(JUMPS):
            up = parent.select(F.col("n").alias("p"), F.col("p").alias("pp"))
            jumped = scratch.put(parent.join(up, "p").select("n", F.col("pp").alias("p")), f"jump{turn}_{k}")
            scratch.drop(parent)
            parent = jumped
        before = labels
        if labels is None:
            labels = parent.select(F.col("n").alias("node"), F.col("p").alias("label"))
        else:
            moved = labels.join(parent.select(F.col("n").alias("label"), "p"), "label", "left")
            labels = scratch.put(moved.select("node", F.coalesce("p", "label").alias("label")), f"labels{turn}")
        to = lambda c: parent.select(F.col("n").alias(c), F.col("p").alias(f"p{c}"))
        rewritten = left.join(to("a"), "a").join(to("b"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        after = scratch.put(_distinct_edges(rewritten), f"edges{turn}")
        scratch.drop(left, before if turn > 1 else None)
        if turn:
            scratch.drop(parent)
        left, turn = after, turn + 1
    return labels

"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util as U


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of `edges` (u, v longs), root being the least node it reaches.

    Each round groups with partial aggregation and joins on the node, so that a
    node of many links is split by adaptive joins; edges are written to the
    shared folder after each round. Every round keeps the components. The loop
    ends when each edge leads from a node to its root.
    """
    e = U.spill(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for n in range(max_rounds):
        # large star: every larger neighbour of a node is linked to the least neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: every smaller neighbour of a node, and the node, to the least
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        before, e = e, U.spill(small.where("u <> v").distinct(), "edges")
        U.drop(before)
        if not n:
            continue  # not to be tried so early
        # done when every node has one edge and no edge ends where another starts
        several = e.groupBy("u").count().where("count > 1").select("u")
        ends = e.select(F.col("v").alias("u")).distinct()
        if several.unionByName(e.select("u").join(ends.hint("merge"), "u", "left_semi")).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def grown(root: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of what `components` gave and of further edges (u, v), stored; only edges between different components are worked on."""
    if edges.isEmpty():
        return root
    for c in ("u", "v"):
        edges = edges.join(root.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")).hint("merge"), c, "left").withColumn(c, F.coalesce(f"root_{c}", c)).drop(f"root_{c}")
    between = U.spill(edges.where("u <> v").distinct(), "edges")
    if between.isEmpty():
        return root
    over = components(between)
    named = root.join(over.select(F.col("node").alias("root"), F.col("root").alias("top")).hint("merge"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    out = U.spill(named.unionByName(over.join(root.select("node").hint("merge"), "node", "left_anti")), "roots")
    U.drop(between)
    return out

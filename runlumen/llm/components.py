"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlumen.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of (a, b); component is the smallest node reached.

    Each round hangs every node on its smallest neighbour, follows the chains to their ends by
    doubling, and replaces nodes by those ends; edges inside one tree vanish. Rounds are logarithmic
    in practice, and every intermediate is a table in the shared folder. A node with very many edges
    costs partial minima and a join that Spark can split, never one task. An empty table gives no rows.
    """
    edges = stage(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        hung = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
            "node", F.least("node", "near").alias("root")), "hung")
        while True:
            above = hung.select(F.col("node").alias("root"), F.col("root").alias("top"))
            step = stage(hung.join(above, "root").select("node", F.col("top").alias("root"), (
                F.col("root") != F.col("top")).alias("moved")), "hung")
            hung = step.select("node", "root")
            if step.filter("moved").isEmpty():
                break
        if labels is None:
            labels = hung
        else:
            onward = hung.select(F.col("node").alias("root"), F.col("root").alias("top"))
            labels = stage(labels.join(onward, "root", "left").select(
                "node", F.coalesce("top", "root").alias("root")), "labels")
        a = hung.select(F.col("node").alias("a"), F.col("root").alias("x"))
        b = hung.select(F.col("node").alias("b"), F.col("root").alias("y"))
        edges = stage(edges.join(a, "a").join(b, "b").filter("x != y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("root").alias("component"))

"""Connected components by contraction, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.lineage import cut


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """`node`, `component` for every end of `edges` (`a`, `b`): the smallest node that edges reach.

    A round hooks every node to its smallest neighbour, if that is smaller, follows the hooks to their ends by doubling, and
    keeps the edges between different ends, each once. So only the first round sees all edges.
    """
    down = lambda e: e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(down(edges))
    labels = now.select(F.col("a").alias("node")).union(now.select(F.col("b").alias("node"))).distinct().withColumn("component", F.col("node"))
    while not now.isEmpty():
        ends = cut(now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")))
        while True:
            further = ends.select(F.col("node").alias("to"), F.col("to").alias("_far"))
            moved = cut(ends.join(further, "to", "left").select("node", F.coalesce("_far", "to").alias("to"), F.col("_far").isNotNull().alias("_moved")))
            ends = moved.select("node", "to")
            if not moved.filter("_moved").take(1):
                break
        end = lambda c: ends.select(F.col("node").alias(c), F.col("to").alias(f"_{c}"))
        renamed = now.join(end("a"), "a").join(end("b"), "b", "left")
        now = cut(down(renamed.select(F.col("_a").alias("a"), F.coalesce("_b", "b").alias("b"))))
        step = ends.select(F.col("node").alias("component"), "to")
        labels = labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return labels

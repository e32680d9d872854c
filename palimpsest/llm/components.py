"""Connected components of a table of links, without moving links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.lineage import cut


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """`node`, `component` for links (`a`, `b`): the smallest node that can be reached.

    Each round takes the smallest label of all neighbours and then the label of that label, so a chain of n links
    needs about log n rounds. A node with very many links is one aggregate with partial sums and a join whose
    large side can be split. Self links and repeated links do no harm; no links give no rows.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    for _ in range(max_rounds):
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        ends = labels.select(F.col("node").alias("via"), F.col("component").alias("end"))
        stepped = cut(
            lower.join(ends, "via").select("node", F.least("via", "end").alias("component"), (F.least("via", "end") != F.col("old")).alias("changed"))
        )
        labels = stepped.select("node", "component")
        if stepped.filter("changed").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b); root is the least node reachable.

    Labels spread to neighbours and then to the label's own label, so distances halve each round; rounds end
    when nothing changes. Every step is a join or a partially aggregated minimum, hubs included, and each round is
    stored, so lineage stays short. An empty table gives no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.filter(F.col("a") != F.col("b")).distinct(), "graph-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "graph-labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        better = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        after = better.join(jump, "root").select("node", "old", F.least("root", "far").alias("root"))
        after = stored(after, "graph-labels")
        if not after.filter(F.col("old") != F.col("root")).limit(1).count():
            return labels
        labels = after.drop("old")

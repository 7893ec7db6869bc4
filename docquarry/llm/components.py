"""Connected components by joins: every node learns the least node it is linked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docquarry.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of ``edges`` (a, b); the label is one node of the component.

    Each round takes the least label among the neighbours and then the label of that label, so
    long chains shrink by halves.  Hot nodes stand on one side of a join of two plain shuffles,
    which adaptive execution may split, and minima are taken before the shuffle.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b")
    both = cut_lineage(both.distinct(), "component-edges")
    labels = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label"))
    labels = cut_lineage(labels, "component-labels")
    while True:
        low = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        )
        near = labels.join(low.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "low").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = cut_lineage(
            near.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")),
            "component-labels",
        )
        changed = step.filter("label != old").limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels

"""Connected components by iterative joins: smallest neighbour labels, then labels of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component is named by its smallest node.

    Labels only fall, and each round is written to the shared folder. Minima are pre-aggregated, so a node with very
    many edges is no hot key of an aggregation; adaptive joins split it.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a != b").distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("least"))
    labels = written(labels.select(F.col("a").alias("node"), F.least("a", "least").alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b")
        least = seen.groupBy("a").agg(F.min("component").alias("least"))
        nearer = labels.join(least, labels.node == least.a).select(
            "node", F.col("component").alias("old"), F.least("component", "least").alias("near")
        )
        nearer = written(nearer, "labels")
        up = nearer.select(F.col("node").alias("up"), F.col("near").alias("further"))
        jumped = nearer.join(up, nearer.near == up.up).select("node", "old", F.col("further").alias("component"))
        jumped = written(jumped, "labels")
        labels = jumped.select("node", "component")
        if jumped.where("old != component").isEmpty():
            return labels

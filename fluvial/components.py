"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvial.staging import discard, hot_keys, join_skewed, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (x, y): label is the least node that it can reach.

    Every round takes the least label among neighbours and then the label's own label, so the number of rounds
    follows the logarithm of the longest path. Each round's labels are written, so a lost executor costs one round.
    Neither a node with very many neighbours nor a component of very many nodes is one task's: such keys are salted.
    """
    both = materialize(edges.select("x", "y").union(edges.select("y", "x")).distinct(), "edges")
    hubs = hot_keys(both, ["y"])
    hubs = hubs if hubs is None else materialize(hubs, "hubs")
    labels = materialize(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")), "labels")

    def of_neighbours(table: DataFrame) -> DataFrame:
        return both.join(table, "y") if hubs is None else join_skewed(both, table, ["y"], ["x"], hot=hubs)

    while True:
        near = of_neighbours(labels.toDF("y", "label")).groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.x).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        before, step = labels, materialize(step, "labels")
        discard(before)
        up = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = materialize(join_skewed(step, up, ["label"], ["node"]).select("node", "old", F.least("label", "up").alias("label")), "labels")
        discard(step)
        if labels.filter("old <> label").isEmpty():
            discard(both, *([] if hubs is None else [hubs]))
            return labels.select("node", "label")
        labels = labels.select("node", "label")

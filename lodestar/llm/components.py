"""Connected components of an edge table, without a vertex or edge ever on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import looked_up, written


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) of every node of ``edges`` (a, b).

    Each round takes the smallest label of the neighbours, then the label of that label, which halves the way to go.
    A round's labels are a table in the shared folder, with one row a node. A node with many neighbours, as the head of a
    star has, and a label with many nodes are hot keys, which ``looked_up`` keeps out of single tasks.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    edge_count, nodes = both.count(), labels.count()
    while True:
        seen = looked_up(both, labels.withColumnRenamed("node", "b"), "b", "a", total=edge_count)
        near = seen.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = written(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = written(looked_up(stepped, jump, "label", "node", total=nodes).select("node", "old", F.least("label", "next").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels

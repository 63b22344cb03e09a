"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component; ``edges`` has long columns a and b.

    Edges with a null end, edges from a node to itself and repeated edges say
    nothing: a node without any other edge is not in the result, and no edges
    give an empty one.

    Every round a node takes the smallest label among its neighbours, then its
    label's label, so labels travel exponentially far; it ends when none
    changes.  Minima are combined before shuffling and labels are unique per
    node, so a node with very many neighbours only splits a join.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                 .where(F.col("a") != F.col("b")).distinct(), "edges")  # a null end compares as neither
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m"))
                   .select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
                .withColumnRenamed("a", "node"))
        low = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        new = stage(low.join(up, "label", "left")
                    .select("node", "old", F.least("label", "higher").alias("label")), "labels")
        done = new.where(F.col("old") != F.col("label")).isEmpty()
        labels = new.select("node", "label")
        if done:
            return labels

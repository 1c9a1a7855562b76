"""Connected components of links between sets, by shuffled joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.common import settled


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the label is the least node that can be reached.

    Each round takes the least label of a node's neighbours and then the label of that label, so
    a chain halves; it ends when no label changes. Rounds are written to the shared folder.
    Without links the result is empty.
    """
    both = settled(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "links")
    labels = settled(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("to"))
        of_label = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        jumped = settled(least.join(of_label, "to").select("node", F.least("to", "further").alias("new"), "label"), "labels")
        if jumped.where("new != label").isEmpty():
            return jumped.select("node", F.col("new").alias("label"))
        labels = jumped.select("node", F.col("new").alias("label"))

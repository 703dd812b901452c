"""Connected components by hooking and pointer jumping; every round ends in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.runtime import cut


def components(edges: DataFrame) -> DataFrame:
    """node, label of every end of an edge (a, b); label is the smallest node it reaches."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("root"), F.col("label").alias("far"))
        after = cut(hooked.join(jump, hooked.label == jump.root).select("node", "was", F.least("label", "far").alias("label")))
        if after.where("was <> label").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")

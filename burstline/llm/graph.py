"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstline.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node of its component.

    Each round, a node takes the smallest label among its neighbours and then the label of that label, so
    that labels cross long chains in few rounds. Rounds are written out, and end when no label changes.
    """
    both = cut(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a")))
               .distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                 .select("node", F.least("node", "m").alias("root")))
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("root").alias("near")))
        stepped = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after = cut(stepped.join(above, "root").select("node", "old", F.col("above").alias("root")))
        if after.where("root <> old").isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")

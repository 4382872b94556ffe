"""Connected components of a link table, without a link or label leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WorkTables


def components(links: DataFrame, work: WorkTables) -> DataFrame:
    """links (a, b) -> (node, root): the least node that can be reached, for every node that has a link.

    Each round a node takes the least label around it, then the label of that label's node, so the
    distance covered doubles; rounds are the logarithm of the longest path. A node's links are summed
    up by min before the shuffle; joins of labels are plain equi-joins, whose hot keys AQE splits.
    Self-links and links given twice or in one direction only are fine; nulls are not allowed.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = work.save(both, "links")
    labels = work.save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels-0")
    at = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        mine = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        onward = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        mine = mine.join(onward, "root").select("node", "old", F.col("next").alias("root"))
        at += 1
        after = work.save(mine, f"labels-{at}")
        changed = after.where("root <> old").limit(1).count()
        work.drop(f"labels-{at - 1}")
        labels = after.select("node", "root")
        if not changed:
            work.drop("links")
            return labels

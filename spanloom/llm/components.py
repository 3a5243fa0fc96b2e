"""Connected components of links, in Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """node, label: the smallest node that links (a, b) reach, for each node that has a link.

    Every node points to a label. A round lowers labels to the least label of a
    neighbour, hooks the old label's node to the new one, and halves the paths of
    labels. Rounds grow with the logarithm of the longest path; a hub's links are
    aggregated before they meet. Ends when no label changes.
    """
    both = work.keep(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = work.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        own = labels.select(F.col("node").alias("a"), F.col("label").alias("mine"))
        near = both.join(labels, both["b"] == labels["node"]).select("a", "label")
        lower = near.groupBy("a").agg(F.min("label").alias("low")).join(own, "a").where("low < mine")
        # The node itself and the node its label names are both lowered.
        moved = lower.select(F.col("a").alias("node"), "low").union(lower.select(F.col("mine").alias("node"), "low")).groupBy("node").agg(F.min("low").alias("low"))
        hooked = labels.join(moved, "node", "left").select("node", F.least("label", F.coalesce("low", "label")).alias("label"), F.col("low").isNotNull().alias("hooked"))
        hooked = work.keep(hooked)
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = hooked.join(up, "label", "left").select("node", F.least("label", F.coalesce("top", "label")).alias("new"), (F.col("hooked") | (F.coalesce("top", "label") < F.col("label"))).alias("changed"))
        after = work.keep(jumped)
        changed = after.where("changed").limit(1).count()
        work.drop(labels, hooked)
        labels = after.select("node", F.col("new").alias("label"))
        if not changed:
            work.drop(both)
            return labels

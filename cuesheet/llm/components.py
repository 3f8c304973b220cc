"""Connected components of an edge table, by repeated minima and pointer jumping over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cuesheet.plans.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of (a, b); label is the smallest node that can be reached.

    Each round takes the smallest label among a node and its neighbours and then that label's own label,
    and is written to the shared folder; it ends when no label changes."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        moved = stage(lower.join(jump, F.col("low") == F.col("via"), "left").select(
            "node", F.least("low", F.coalesce("beyond", "low")).alias("label"),
            (F.least("low", F.coalesce("beyond", "low")) != F.col("label")).alias("changed")), "labels")
        labels = moved.select("node", "label")
        if not moved.filter("changed").limit(1).count():
            return labels

"""Connected components of an edge list by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (u, v); component is the smallest node reachable.

    Each round takes the least label among the neighbours, hangs the old label under it,
    and then jumps to the label's own label, so long chains shorten geometrically. Every round is
    grouped aggregation and equi-joins; the driver sees one number, the labels that changed.
    Labels are cut from their lineage by a reliable checkpoint each round.
    """
    both = materialize(edges.union(edges.select("v", "u")).distinct())
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("component"))
    labels = materialize(labels)
    while True:
        heard = (
            both.join(labels.select(F.col("node").alias("v"), "component"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("component").alias("heard"))
        )
        told = labels.join(heard, "node").select("node", F.col("component").alias("old"), F.least("component", "heard").alias("new"))
        hung = told.filter("new < old").groupBy(F.col("old").alias("node")).agg(F.min("new").alias("under"))
        lower = told.join(hung, "node", "left").select("node", "old", F.least("new", F.coalesce("under", "new")).alias("new"))
        root = lower.select(F.col("node").alias("new"), F.col("new").alias("root"))
        jumped = materialize(lower.join(root, "new").select("node", "old", F.least("new", "root").alias("component")))
        changed = jumped.filter("component < old").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels

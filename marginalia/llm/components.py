"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of `edges` (a, b): comp is the smallest node that it reaches.

    Each round every node takes the least label around it and then its label's label; the loop ends when no label
    falls. Minima are pre-aggregated, so a node with very many edges doesn't gather them in one task, and the joins
    have plain exchanges on both sides, which AQE can split. No edge or label is collected.
    """
    both = ws.put(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = ws.put(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = ws.put(labels.join(around, "node").select("node", "comp", F.least("comp", "near").alias("low")), "lower")
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("next"))
        after = ws.put(lower.join(jump, "low").select("node", F.col("next").alias("comp"), (F.col("next") != F.col("comp")).alias("moved")), "labels")
        ws.drop(labels, lower)
        labels = after
        if not after.filter("moved").limit(1).count():
            ws.drop(both)
            return labels.select("node", "comp")

"""Connected components by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import hot_join, settle


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): the smallest node reachable, for every node of an edge.

    Each round takes the smallest label among the neighbours and then the label's label, so
    the rounds grow with the logarithm of a component's diameter.  Every round is written to
    the shared folder.  A node with very many edges is answered by ``hot_join``."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = settle(both.filter("u <> v").distinct(), "cc-edges")
    nodes = both.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("degree"))
    labels = settle(nodes.select(F.col("u").alias("node"), F.least("u", "low").alias("label"), "degree"), "cc-labels")
    while True:
        seen = hot_join(both, labels.select(F.col("node").alias("v"), "label", "degree"), "v", [F.col("u")], "label", "degree")
        best = seen.groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = settle(labels.join(best, "node").select("node", "degree", F.col("label").alias("before"), F.least("label", "near").alias("at")), "cc-step")
        if step.filter("at <> before").isEmpty():
            return labels.select("node", "label")
        # the label's label; a root is the label of a third of the rows at worst
        weight = step.groupBy("at").agg(F.count(F.lit(1)).alias("n"))
        jump = step.select(F.col("node").alias("at"), F.col("at").alias("up")).join(weight, "at")
        labels = settle(hot_join(step, jump, "at", [F.col("node")], "up", "n").select("node", F.coalesce("up", "at").alias("label"), "degree"), "cc-labels")

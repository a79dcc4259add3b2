"""M2, M9: fitted tree ensembles as tables of nodes, scored and explained along their paths.

A fitted ensemble is saved as MLlib saves it and read back as rows: one node each, with its split
and its value, the share of positives (forest) or the mean residual (boosting).  A row's score
is the weighted sum of the leaves it reaches.  Walking down a tree, each split changes the
value from the parent's to the child's; these changes, summed by the feature of the split, are
the row's exact path attributions: with the weighted values of the roots (the base) they add up
to the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path


def tree_nodes(spark: SparkSession, model) -> DataFrame:
    """tree, weight, node, feature, threshold, left, right (-1 at a leaf), value of a fitted
    forest or boosted classifier with two classes and continuous features."""
    path = shared_path(spark, "trees")
    model.write().save(path)
    n = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    boosted = "GBT" in type(model).__name__
    meta = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "_meta", "weight").select("treeID", "weight")
    stats = F.col("impurityStats")
    value = F.col("prediction") if boosted else F.get(stats, F.lit(1)) / F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    weight = F.col("weight") if boosted else F.lit(1.0 / model.getNumTrees)
    return n.join(F.broadcast(meta), "treeID").select(
        F.col("treeID").alias("tree"), weight.alias("weight"), F.col("id").alias("node"), F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), value.alias("value"))


@dataclass
class _Tree:
    weight: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray


def _trees(nodes: DataFrame) -> list[_Tree]:
    """The table as arrays: as many rows as the ensemble has nodes, under trees x 2^(depth + 1)."""
    out = []
    for _, t in nodes.toPandas().sort_values(["tree", "node"]).groupby("tree"):
        if t["node"].tolist() != list(range(len(t))):
            raise ValueError("nodes of a tree are not numbered from 0")
        out.append(_Tree(float(t["weight"].iloc[0]), *(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "value"))))
    return out


def walk(trees: list[_Tree], x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Base, score of each row of ``x``, and its attributions by feature."""
    rows = np.arange(len(x))
    base, score, parts = 0.0, np.zeros(len(x)), np.zeros(x.shape)
    for t in trees:
        at = np.zeros(len(x), np.int64)
        base += t.weight * float(t.value[0])
        while (inner := t.left[at] >= 0).any():
            r, a = rows[inner], at[inner]
            f = t.feature[a]
            child = np.where(x[r, f] <= t.threshold[a], t.left[a], t.right[a])
            parts[r, f] += t.weight * (t.value[child] - t.value[a])  # a row comes once in a step
            at[inner] = child
        score += t.weight * t.value[at]
    return base, score, parts


def attributions(df: DataFrame, nodes: DataFrame, features: str = "features", out: str = "path") -> DataFrame:
    """``df`` with ``out``: struct of base, score and contributions (one per feature) under the
    ensemble of ``nodes``.  The score of a boosted ensemble is its margin."""
    trees = _trees(nodes)

    @F.pandas_udf("base double, score double, contributions array<double>")
    def explain(x: pd.Series) -> pd.DataFrame:
        base, score, parts = walk(trees, np.stack(x.to_numpy())) if len(x) else (0.0, np.zeros(0), np.zeros((0, 0)))
        return pd.DataFrame({"base": base, "score": score, "contributions": list(parts)})

    return df.withColumn(out, explain(vector_to_array(F.col(features))))


def probability(score: Column, boosted: bool) -> Column:
    """Probability of the positive class from an ensemble's score."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * score)) if boosted else score

"""Scoring with MLlib: features, member models, vote, calibration, decision.

Models are fitted on a hash-selected training part and applied with
pipeline ``transform`` (distributed).  Only model parameters (small, bounded
by the number of features) ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import seeded_hash

MEMBER_WEIGHTS = {"rf_shallow": 0.3, "rf_deep": 0.25, "gbt": 0.25, "gbt_slow": 0.2}


def read_embeddings(df: DataFrame, col: str = "embedding") -> DataFrame:
    return df.withColumn("features_raw", array_to_vector(F.col(col)))


def pca_features(df: DataFrame, fit_on: DataFrame | None = None, k: int = 32, in_col: str = "features_raw",
                 out_col: str = "pca") -> DataFrame:
    """PCA fitted on ``fit_on`` (the training rows), applied to ``df``."""
    model = PCA(k=k, inputCol=in_col, outputCol=out_col).fit(df if fit_on is None else fit_on)
    return model.transform(df)


def assemble_scale(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None, out_col: str = "features") -> DataFrame:
    """One scaled vector; means and deviations from ``fit_on`` (the training rows)."""
    va = VectorAssembler(inputCols=list(cols), outputCol="_assembled", handleInvalid="keep")
    sc = StandardScaler(inputCol="_assembled", outputCol=out_col, withMean=True, withStd=True)
    return Pipeline(stages=[va, sc]).fit(df if fit_on is None else fit_on).transform(df).drop("_assembled")


def drop_component(df: DataFrame, index: int, col: str = "pca") -> DataFrame:
    """The vector without one of its components."""
    x = vector_to_array(F.col(col))
    return df.withColumn(col, array_to_vector(F.concat(F.slice(x, 1, index), F.slice(x, index + 2, F.size(x)))))


def scale_block(df: DataFrame, factor: float, col: str = "pca") -> DataFrame:
    """A block of features weighted against the others."""
    return df.withColumn(col, array_to_vector(F.transform(vector_to_array(F.col(col)), lambda v: v * F.lit(float(factor)))))


def split_part(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    u = F.conv(F.substring(seeded_hash(key, seed), 1, 8), 16, 10).cast("double") / float(16 ** 8)
    return df.withColumn("part", F.when(u < 0.6, "train").when(u < 0.8, "val").otherwise("test"))


def fit_members(train: DataFrame, features: str = "features", label: str = "label", weight: str | None = None,
                only: Sequence[str] | None = None):
    """Four diverse tree members (depth, trees, learning rate, family) and a linear one
    that has no vote."""
    kw = {"featuresCol": features, "labelCol": label}
    if weight:
        kw["weightCol"] = weight
    members = {
        "rf_shallow": RandomForestClassifier(numTrees=30, maxDepth=4, seed=1, **kw),
        "rf_deep": RandomForestClassifier(numTrees=20, maxDepth=8, seed=2, **kw),
        "gbt": GBTClassifier(maxIter=15, maxDepth=3, stepSize=0.2, seed=3, **kw),
        "gbt_slow": GBTClassifier(maxIter=20, maxDepth=2, stepSize=0.1, seed=4, **kw),
        "logreg": LogisticRegression(maxIter=50, regParam=0.01, **kw),
    }
    return {name: est.fit(train) for name, est in members.items() if only is None or name in only}


def member_scores(df: DataFrame, models: dict, features: str = "features") -> DataFrame:
    out = df
    for name, m in models.items():
        m.setPredictionCol(f"_pred_{name}").setProbabilityCol(f"_prob_{name}")
        if hasattr(m, "setRawPredictionCol"):
            m.setRawPredictionCol(f"_raw_{name}")
        out = m.transform(out)
        out = out.withColumn(f"p_{name}", F.get(vector_to_array(F.col(f"_prob_{name}")), 1)).drop(
            f"_pred_{name}", f"_prob_{name}", f"_raw_{name}")
    return out.withColumn("individual_models", F.create_map(*[x for n in models for x in (F.lit(n), F.col(f"p_{n}"))]))


def weighted_vote(df: DataFrame, weights: dict[str, float], out: str = "score") -> DataFrame:
    missing = [n for n in weights if f"p_{n}" not in df.columns]
    if missing:
        raise ValueError(f"no member score for weights {missing}")
    expr = None
    for n, w in weights.items():
        t = F.lit(w) * F.col(f"p_{n}")
        expr = t if expr is None else expr + t
    return df.withColumn(out, expr)


def calibrate(df: DataFrame, val: DataFrame, score: str = "score", label: str = "label", out: str = "calibrated") -> DataFrame:
    iso = IsotonicRegression(featuresCol=score, labelCol=label, predictionCol=out).fit(val)
    return iso.transform(df)


def decide(df: DataFrame, threshold: float = 0.5, score: str = "calibrated") -> DataFrame:
    flag = F.col(score) >= threshold
    return (df.withColumn("is_vulnerable", flag).withColumn("label_pred", F.when(flag, "vulnerable").otherwise("safe"))
            .withColumn("threshold", F.lit(threshold)))


def decide_presets(df: DataFrame, presets: dict[str, float], score: str = "calibrated") -> DataFrame:
    """Flagged and all rows at each named threshold, in one scan."""
    rows = F.array(*[F.struct(F.lit(n).alias("preset"), F.lit(t).alias("threshold"), (F.col(score) >= t).alias("_f")) for n, t in presets.items()])
    return df.select(F.inline(rows)).groupBy("preset", "threshold").agg(
        F.count_if("_f").alias("flagged"), F.count(F.lit(1)).alias("total"))


def stack_members(train: DataFrame, members: Sequence[str], label: str = "label"):
    va = VectorAssembler(inputCols=[f"p_{m}" for m in members], outputCol="_meta")
    lr = LogisticRegression(featuresCol="_meta", labelCol=label, predictionCol="_stack_pred",
                            probabilityCol="_stack_prob", rawPredictionCol="_stack_raw")
    return Pipeline(stages=[va, lr]).fit(train)


def fp_drivers(df: DataFrame, contributions: str = "contributions", label: str = "label", pred: str = "is_vulnerable",
               k: int = 3, names: Sequence[str] | None = None) -> DataFrame:
    """Share of false positives having each feature among their top-k positive contributions
    (an array with one per feature, as ``trees.attributions`` gives them); a row's
    contributions are ranked in its own array."""
    fp = df.filter(F.col(pred) & (F.col(label) == 0)).select(F.col(contributions).alias("_c"))
    ranked = F.array_sort(F.filter(F.transform("_c", lambda v, i: F.struct((-v).alias("v"), i.alias("feature"))), lambda s: s["v"] < 0))
    top = fp.select(F.explode(F.slice(ranked, 1, k)).alias("t")).select("t.feature")
    n_fp = fp.select(F.count(F.lit(1))).scalar()
    out = top.groupBy("feature").agg(F.count(F.lit(1)).alias("n_fp_top"))
    out = out.withColumn("share", F.round(F.try_divide(F.col("n_fp_top"), n_fp), 6))
    if names:
        out = out.withColumn("name", F.get(F.array(*[F.lit(x) for x in names]), F.col("feature")))
    return out

"""MLlib scoring queries (S12, X10, X11, M1, M2, M4, M5, M6, M9).  What a fit gives has no SQL;
what must hold for it has: isotonic values, PCA identities, sums of attributions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import scoring as SC
from ..operators import trees as TR
from ..session import shared_path
from . import views as V
from .registry import register


PCA_K = 32
VOTERS = list(SC.MEMBER_WEIGHTS)


def _prepared(spark, d):
    """Embeddings split into parts first; PCA and scaling learn from the training part."""
    e = SC.read_embeddings(V.table(spark, d, "embeddings"))
    e = e.withColumn("label", (F.col("label") % 2 == 0).cast("int"))
    train = lambda x: x.filter(F.col("part") == "train")
    e = SC.split_part(e, "vec_id")
    e = SC.pca_features(e, train(e), k=PCA_K)
    return SC.assemble_scale(e, ["pca"], train(e))


def _settled(spark, df):
    """Written once to the shared folder: several fits and the result read the same rows."""
    path = shared_path(spark, "models")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@register("read_embeddings", "SELECT vec_id, label, len(embedding) AS dim, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings")
def read_embeddings(spark, d):
    e = SC.read_embeddings(V.table(spark, d, "embeddings"))
    return e.select("vec_id", "label", F.size("embedding").alias("dim"), F.get("embedding", 0).cast("double").alias("first"))


@register("pca_embeddings")
def pca_embeddings(spark, d):
    """PCA-32 of the embeddings, then standard scaling."""
    e = _prepared(spark, d)
    from pyspark.ml.functions import vector_to_array
    return e.select("vec_id", vector_to_array("features").alias("features"))


@register("ensemble_predictions")
def ensemble_predictions(spark, d):
    """M1-M5: four members -> weighted vote -> isotonic calibration on val -> decision."""
    e = _settled(spark, _prepared(spark, d))
    models = SC.fit_members(e.filter(F.col("part") == "train"))
    scored = SC.weighted_vote(SC.member_scores(e, models), SC.MEMBER_WEIGHTS)
    cal = SC.calibrate(scored, scored.filter(F.col("part") == "val"))
    out = SC.decide(cal, 0.5)
    return out.select("vec_id", "part", "label", "score", "calibrated", "is_vulnerable", "label_pred", "threshold",
                      "individual_models")


@register("stacked_predictions")
def stacked_predictions(spark, d):
    """M6: logistic meta-model over the scores of the voting members."""
    e = _settled(spark, _prepared(spark, d))
    models = SC.fit_members(e.filter(F.col("part") == "train"), only=VOTERS)
    scored = SC.member_scores(e, models)
    meta = SC.stack_members(scored.filter(F.col("part") == "val"), VOTERS)
    from pyspark.ml.functions import vector_to_array
    return meta.transform(scored).select("vec_id", "label", F.get(vector_to_array("_stack_prob"), 1).alias("stack_score"))


@register("feature_importance")
def feature_importance(spark, d):
    """M9: global importance of the forest member (a vector bounded by the feature count)."""
    e = _settled(spark, _prepared(spark, d))
    models = SC.fit_members(e.filter(F.col("part") == "train"), only=["rf_deep"])
    imp = models["rf_deep"].featureImportances.toArray().tolist()
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(imp)], "feature int, importance double")


@register("fp_drivers")
def fp_drivers(spark, d):
    """M9 (second part): which features most often drive false positives, by the path attributions of the deep forest."""
    e = _settled(spark, _prepared(spark, d))
    models = SC.fit_members(e.filter(F.col("part") == "train"), only=VOTERS)
    scored = SC.decide(SC.weighted_vote(SC.member_scores(e, models), SC.MEMBER_WEIGHTS), 0.5, score="score")
    paths = TR.attributions(scored, TR.tree_nodes(spark, models["rf_deep"]))
    return SC.fp_drivers(paths.withColumn("contributions", F.col("path.contributions")), k=3, names=[f"pca{i}" for i in range(PCA_K)])


@register("member_attributions", "SELECT vec_id, member, TRUE AS adds_up, TRUE AS same_score FROM embeddings, (VALUES " + ", ".join(f"('{m}')" for m in VOTERS) + ") AS m(member)")
def member_attributions(spark, d):
    """M1, M2, M9: every member as a table of nodes; base and contributions add up to its score,
    and the score of the table is the one that the fitted model gives."""
    e = _settled(spark, _prepared(spark, d))
    models = SC.fit_members(e.filter(F.col("part") == "train"), only=VOTERS)
    scored = SC.member_scores(e, models)
    rows = []
    for name, model in models.items():
        scored = TR.attributions(scored, TR.tree_nodes(spark, model), out=f"_{name}")
        path = F.col(f"_{name}")
        total = path["base"] + F.aggregate(path["contributions"], F.lit(0.0), lambda a, x: a + x)
        same = F.abs(TR.probability(path["score"], name.startswith("gbt")) - F.col(f"p_{name}")) < 1e-9
        rows.append(F.struct(F.lit(name).alias("member"), (F.abs(total - path["score"]) < 1e-9).alias("adds_up"), same.alias("same_score")))
    return scored.select("vec_id", F.inline(F.array(*rows)))


@register("calibrated_scores", """
WITH g AS (SELECT score, sum(label)::DOUBLE AS y, count(*)::DOUBLE AS n, row_number() OVER (ORDER BY score) AS i FROM v_scored GROUP BY score),
c AS (SELECT score, i, sum(y) OVER (ORDER BY i) AS cy, sum(n) OVER (ORDER BY i) AS cn, y, n FROM g),
p AS (SELECT a.i AS j, b.i AS k, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON a.i <= b.i),
low AS (SELECT j, k AS i, min(mean) OVER (PARTITION BY j ORDER BY k DESC) AS low FROM p),
fit AS (SELECT i, max(low) AS calibrated FROM low GROUP BY i)
SELECT s.id, round(f.calibrated, 6) AS calibrated FROM v_scored s JOIN g USING (score) JOIN fit f USING (i)""")
def calibrated_scores(spark, d):
    """M4: isotonic calibration; SQL has the min-max form, the greatest of the least means of intervals."""
    s = _settled(spark, V.v_scored(spark, d).select("id", "score", F.col("label").cast("double").alias("label")))
    return SC.calibrate(s, s).select("id", F.round("calibrated", 6).alias("calibrated"))


@register("pca_quality", f"""
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT (SELECT count(*) FROM embeddings) AS n, {PCA_K} AS k, round(sum(var), 6) AS total_variance, TRUE AS orthonormal, TRUE AS adds_up
FROM (SELECT var_samp(v) AS var FROM x GROUP BY i) t""")
def pca_quality(spark, d):
    """X11: the principal components are orthonormal, and what they explain and what they leave add up to the variance."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array
    e = SC.read_embeddings(V.table(spark, d, "embeddings"))
    model = PCA(k=PCA_K, inputCol="features_raw", outputCol="pca").fit(e)
    pc = model.pc.toArray()
    orthonormal = bool(np.abs(pc.T @ pc - np.eye(PCA_K)).max() < 1e-8)

    @F.pandas_udf("array<double>")
    def left(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy())
        return pd.Series(list(m - m @ pc @ pc.T))

    rows = model.transform(e).select(vector_to_array("features_raw").alias("x"), vector_to_array("pca").alias("z")).withColumn("r", left("x"))
    places = lambda c: F.transform(c, lambda v, i: F.struct(F.lit(c).alias("what"), i.alias("i"), v.alias("v")))
    long = rows.select(F.inline(F.flatten(F.array(*[places(c) for c in ("x", "z", "r")]))))
    var = long.groupBy("what", "i").agg(F.var_samp("v").alias("var"))
    of = lambda c: F.sum(F.when(F.col("what") == c, F.col("var")))
    sums = var.agg(of("x").alias("total"), of("z").alias("explained"), of("r").alias("rest"))
    n = e.select(F.count(F.lit(1))).scalar()
    return sums.select(n.alias("n"), F.lit(PCA_K).alias("k"), F.round("total", 6).alias("total_variance"), F.lit(orthonormal).alias("orthonormal"),
                       (F.abs(F.col("total") - F.col("explained") - F.col("rest")) < 1e-6).alias("adds_up"))


@register("feature_blocks", """
WITH b AS (SELECT vec_id, list_transform(list_concat(embedding[1:3], embedding[5:]), lambda x: x::DOUBLE * 0.6) AS block FROM embeddings)
SELECT vec_id, len(block) AS dim, round(block[4], 6) AS fourth, round(list_sum(block), 6) AS total FROM b""")
def feature_blocks(spark, d):
    """A block without its noisy component, weighted against the others."""
    from pyspark.ml.functions import vector_to_array
    e = SC.read_embeddings(V.table(spark, d, "embeddings"))
    e = SC.scale_block(SC.drop_component(e, 3, "features_raw"), 0.6, "features_raw")
    x = vector_to_array("features_raw")
    return e.select("vec_id", F.size(x).alias("dim"), F.round(F.get(x, F.lit(3)), 6).alias("fourth"), F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))

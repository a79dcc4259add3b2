"""Evaluation and decision queries (E1-E14, M3, M5, M7, M8, M10, W12, L6, L7) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators.helpers import global_rank
from ..sources.fixed import sql_values
from . import views as V
from .registry import register

GATE_T1 = EV.frange(0.20, 0.70, 0.05)
GATE_T2 = EV.frange(0.20, 0.55, 0.05)
PRESETS = [("high_recall", 0.3), ("balanced", 0.5), ("high_precision", 0.7)]


def _div(a, b):
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


def metrics_sql(src: str) -> str:
    return f"""SELECT *, CASE WHEN "precision" + recall = 0 THEN 0.0
                     ELSE 2.0 * "precision" * recall / ("precision" + recall) END AS f1,
       {_div('tn', 'tn + fp')} AS specificity, {_div('fp', 'fp + tn')} AS fpr, {_div('fn', 'fn + tp')} AS fnr
FROM (SELECT *, {_div('tp', 'tp + fp')} AS "precision", {_div('tp', 'tp + fn')} AS recall FROM ({src}) s0) s1"""


def conf_sql(pred: str, by: str = "", src: str = "v_scored") -> str:
    sel = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return (f"SELECT {sel}count_if(NOT ({pred}) AND label <> 1) AS tn, count_if(({pred}) AND label <> 1) AS fp, "
            f"count_if(NOT ({pred}) AND label = 1) AS fn, count_if(({pred}) AND label = 1) AS tp FROM {src}{grp}")


def _grid_sql(grid, name="threshold"):
    return sql_values([(float(t),) for t in grid], [name])


SWEEP_SQL = metrics_sql(f"""
SELECT g.threshold, count_if(s.score >= g.threshold AND s.label = 1) AS tp, count_if(s.score >= g.threshold AND s.label <> 1) AS fp,
       count_if(NOT (s.score >= g.threshold) AND s.label = 1) AS fn, count_if(NOT (s.score >= g.threshold) AND s.label <> 1) AS tn
FROM {_grid_sql(EV.SWEEP_GRID)} AS g JOIN v_scored s ON TRUE GROUP BY g.threshold""".replace(") AS t(threshold) AS g", ") AS g(threshold)"))

METRIC_COLS = ["tn", "fp", "fn", "tp", "precision", "recall", "f1", "specificity", "fpr", "fnr"]
METRIC_COLS_SQL = 'tn, fp, fn, tp, "precision", recall, f1, specificity, fpr, fnr'


def _scored(spark, d):
    return V.v_scored(spark, d)


@register("confusion", conf_sql("score >= 0.5"))
def confusion(spark, d):
    return EV.confusion(_scored(spark, d), EV.flag("score", 0.5))


@register("binary_metrics", metrics_sql(conf_sql("score >= 0.5")))
def binary_metrics(spark, d):
    return EV.with_metrics(EV.confusion(_scored(spark, d), EV.flag("score", 0.5)))


@register("binary_metrics_exclusive", metrics_sql(conf_sql("score > 0.5")))
def binary_metrics_exclusive(spark, d):
    """The evaluation-script variant that flags with '>' instead of '>='."""
    return EV.with_metrics(EV.confusion(_scored(spark, d), EV.flag("score", 0.5, inclusive=False)))


@register("class_metrics", f"""
WITH c AS ({conf_sql('score >= 0.5')})
SELECT 0 AS class, {_div('tn', 'tn + fn')} AS "precision", {_div('tn', 'tn + fp')} AS recall FROM c
UNION ALL SELECT 1, {_div('tp', 'tp + fp')}, {_div('tp', 'tp + fn')} FROM c""")
def class_metrics(spark, d):
    return EV.class_metrics(_scored(spark, d), EV.flag("score", 0.5))


@register("roc_auc", """
WITH lv AS (SELECT score, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM v_scored GROUP BY score),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM lv),
a AS (SELECT CAST(sum(pos * (neg_below * 2 + neg)) AS BIGINT) AS num2, CAST(sum(pos) AS BIGINT) AS P,
             CAST(sum(neg) AS BIGINT) AS N FROM c)
SELECT CASE WHEN P * N * 2 = 0 THEN 0.0 ELSE CAST(num2 AS DOUBLE) / CAST(P * N * 2 AS DOUBLE) END AS roc_auc,
       P AS n_pos, N AS n_neg FROM a""")
def roc_auc(spark, d):
    return EV.roc_auc(_scored(spark, d))


@register("pr_auc", """
WITH lv AS (SELECT score, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM v_scored GROUP BY score),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp_cum,
             sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp_cum FROM lv)
SELECT CASE WHEN sum(pos) = 0 THEN 0.0
            ELSE round(sum(pos * (CAST(tp_cum AS DOUBLE) / CAST(tp_cum + fp_cum AS DOUBLE))) / CAST(sum(pos) AS DOUBLE), 6) END
       AS pr_auc FROM c""")
def pr_auc(spark, d):
    return EV.pr_auc(_scored(spark, d))


@register("brier", "SELECT round(avg((score - label) * (score - label)), 6) AS brier FROM v_scored")
def brier(spark, d):
    return EV.brier(_scored(spark, d))


@register("threshold_sweep", f"SELECT threshold, {METRIC_COLS_SQL} FROM ({SWEEP_SQL}) x")
def threshold_sweep(spark, d):
    """200-step sweep .15-.85 in one pass (bucket each score once)."""
    return EV.threshold_sweep(_scored(spark, d)).select("threshold", *METRIC_COLS)


@register("pick_threshold", f"""
WITH sw AS ({SWEEP_SQL}),
b AS (SELECT threshold, f1 FROM sw ORDER BY f1 DESC, threshold LIMIT 1)
SELECT b.threshold AS best_f1_threshold, b.f1 AS best_f1,
       coalesce((SELECT min(threshold) FROM sw WHERE recall >= 0.75), b.threshold) AS recall_biased_threshold FROM b""")
def pick_threshold(spark, d):
    return EV.pick_threshold(EV.threshold_sweep(_scored(spark, d)))


_VECS = EV.weight_vectors(0.05, 4)
_VEC_SQL = sql_values([(i, *v) for i, v in enumerate(_VECS)], ["vid", "w1", "w2", "w3", "w4"]).replace(
    ") AS t(vid", ") AS wv(vid")


@register("weight_grid", f"""
WITH fl AS (SELECT wv.vid, wv.w1, wv.w2, wv.w3, wv.w4, s.label,
                   wv.w1 * s.s1 + wv.w2 * s.s2 + wv.w3 * s.s3 + wv.w4 * s.s4 >= 0.5 AS f
            FROM {_VEC_SQL} JOIN v_scored s ON TRUE),
c AS (SELECT vid, w1, w2, w3, w4, count_if(f AND label = 1) AS tp, count_if(f AND label <> 1) AS fp,
             count_if(NOT f AND label = 1) AS fn, count_if(NOT f AND label <> 1) AS tn FROM fl GROUP BY vid, w1, w2, w3, w4)
SELECT vid, w1, w2, w3, w4, {METRIC_COLS_SQL} FROM ({metrics_sql('SELECT * FROM c')}) x""")
def weight_grid(spark, d):
    """969 weight vectors (step .05) scored in one pass, F1 at threshold .5."""
    g = EV.weight_grid(_scored(spark, d), ["s1", "s2", "s3", "s4"])
    return g.select("vid", "w1", "w2", "w3", "w4", *METRIC_COLS)


@register("gate_grid", metrics_sql(f"""
SELECT a.t1, b.t2, count_if(s.stage1 >= a.t1 AND s.stage2 >= b.t2 AND s.label = 1) AS tp,
       count_if(s.stage1 >= a.t1 AND s.stage2 >= b.t2 AND s.label <> 1) AS fp,
       count_if(NOT (s.stage1 >= a.t1 AND s.stage2 >= b.t2) AND s.label = 1) AS fn,
       count_if(NOT (s.stage1 >= a.t1 AND s.stage2 >= b.t2) AND s.label <> 1) AS tn
FROM {_grid_sql(GATE_T1, 't1').replace(') AS t(t1)', ') AS a(t1)')} JOIN {_grid_sql(GATE_T2, 't2').replace(') AS t(t2)', ') AS b(t2)')} ON TRUE
JOIN v_scored s ON TRUE GROUP BY a.t1, b.t2"""))
def gate_grid(spark, d):
    """Two-stage gate over 11 x 8 = 88 threshold pairs from 2-D bucket counts."""
    return EV.gate_grid(_scored(spark, d), "stage1", "stage2", GATE_T1, GATE_T2)


@register("two_stage_gate", metrics_sql(conf_sql("stage1 >= 0.45 AND stage2 >= 0.35")))
def two_stage_gate(spark, d):
    return EV.with_metrics(EV.confusion(_scored(spark, d), (F.col("stage1") >= 0.45) & (F.col("stage2") >= 0.35)))


CAT = "coalesce(category, 'Unknown')"


@register("metrics_by_category", metrics_sql(
    f"SELECT {CAT} AS category, count(*) AS n, " + conf_sql("score >= 0.5").replace("SELECT ", "", 1)
    + f" GROUP BY {CAT}"))
def metrics_by_category(spark, d):
    return EV.metrics_by_category(_scored(spark, d), EV.flag("score", 0.5))


@register("top_categories", "SELECT category, f1 FROM (" + metrics_sql(
    f"SELECT {CAT} AS category, count(*) AS n, " + conf_sql("score >= 0.5").replace("SELECT ", "", 1)
    + f" GROUP BY {CAT}") + ") x ORDER BY f1 DESC, category LIMIT 10")
def top_categories(spark, d):
    return metrics_by_category(spark, d).orderBy(F.desc("f1"), "category").limit(10).select("category", "f1")


@register("triage_flags", "SELECT category, array_to_string(list_filter([" + ", ".join([
    "CASE WHEN \"precision\" < 0.5 THEN 'low precision: many false positives' END",
    "CASE WHEN recall < 0.6 THEN 'low recall: many missed vulnerabilities' END",
    "CASE WHEN f1 < 0.5 THEN 'weak overall: consider more data or features' END",
    "CASE WHEN f1 >= 0.7 THEN 'strong category' END"]) + "], lambda x: x IS NOT NULL), '; ') AS advice FROM (" + metrics_sql(
    f"SELECT {CAT} AS category, count(*) AS n, " + conf_sql("score >= 0.5").replace("SELECT ", "", 1)
    + f" GROUP BY {CAT}") + ") x")
def triage_flags(spark, d):
    return EV.triage_flags(metrics_by_category(spark, d)).select("category", F.array_join("advice", "; ").alias("advice"))


@register("metrics_delta", f"""
WITH a AS ({metrics_sql(conf_sql('score >= 0.5'))}), b AS ({metrics_sql(conf_sql('score >= 0.4'))}),
l AS (SELECT 'precision' AS metric, a."precision" AS run_a, b."precision" AS run_b FROM a, b
      UNION ALL SELECT 'recall', a.recall, b.recall FROM a, b UNION ALL SELECT 'f1', a.f1, b.f1 FROM a, b)
SELECT metric, run_a, run_b, run_b - run_a AS delta,
       CASE WHEN run_a = 0 THEN NULL ELSE round((run_b - run_a) / run_a * 100.0, 6) END AS pct FROM l""")
def metrics_delta(spark, d):
    """Run-to-run change: threshold .5 (run a) vs .4 (run b), per metric, in one pass."""
    return EV.metrics_delta(_scored(spark, d), EV.flag("score", 0.5), EV.flag("score", 0.4))


@register("weighted_vote", "SELECT id, score FROM v_scored")
def weighted_vote(spark, d):
    from ..operators import scoring as SC
    names = [f"s{i}" for i in range(1, 5)]
    s = _scored(spark, d).drop("score").withColumnsRenamed({n: f"p_{n}" for n in names})
    return SC.weighted_vote(s, dict(zip(names, V.MEMBER_WEIGHTS))).select("id", "score")


@register("decide_presets", " UNION ALL ".join(
    f"SELECT '{n}' AS preset, {t} AS threshold, count_if(score >= {t}) AS flagged, count(*) AS total FROM v_scored"
    for n, t in PRESETS))
def decide_presets(spark, d):
    """M5 at the three presets: one scan, one row a preset and example."""
    from ..operators import scoring as SC
    return SC.decide_presets(_scored(spark, d), dict(PRESETS), score="score")


@register("down_weight_noise", """
SELECT id, CASE WHEN (label = 0 AND score > 0.8) OR (label = 1 AND score < 0.2) THEN 0.3 ELSE 1.0 END AS weight,
       (label = 0 AND score > 0.8) OR (label = 1 AND score < 0.2) AS is_noise FROM v_scored""")
def down_weight_noise(spark, d):
    return EV.noise_weights(_scored(spark, d)).select("id", "weight", "is_noise")


@register("review_list", """
SELECT id, score, label FROM v_scored WHERE (label = 0 AND score > 0.8) OR (label = 1 AND score < 0.2)
ORDER BY abs(score - label) DESC, id LIMIT 50""")
def review_list(spark, d):
    """M8: the 50 surest contradictions of label and score, to be looked at by hand."""
    return EV.review_list(_scored(spark, d)).select("id", "score", "label")


@register("loss_metrics", """
WITH p AS (SELECT label, least(greatest(score, 1e-7), 1 - 1e-7) AS p FROM v_scored)
SELECT round(avg(CASE WHEN label = 1 THEN -0.75 * pow(1.0 - p, 2.0) * ln(p)
                      ELSE -(1 - 0.75) * pow(p, 2.0) * ln(1.0 - p) END), 6) AS focal_loss,
       round(avg(CASE WHEN label = 1 THEN -1.0 * ln(p) ELSE -1.0 * ln(1.0 - p) END), 6) AS cross_entropy FROM p""")
def loss_metrics(spark, d):
    s = _scored(spark, d)
    return s.agg(F.round(F.avg(EV.focal_loss(s)), 6).alias("focal_loss"),
                 F.round(F.avg(EV.weighted_ce()), 6).alias("cross_entropy"))


@register("running_rank", """
WITH lv AS (SELECT score, count(*) AS n FROM v_scored GROUP BY score),
c AS (SELECT score, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                    + (n + 1) / 2.0 AS avg_rank FROM lv)
SELECT s.id, c.avg_rank FROM v_scored s JOIN c USING (score)""")
def running_rank(spark, d):
    return EV.running_rank(_scored(spark, d)).select("id", "avg_rank")


@register("precision_at_10pct", """
WITH r AS (SELECT label, row_number() OVER (ORDER BY score DESC, id) AS rk, count(*) OVER () AS n FROM v_scored)
SELECT round(avg(label), 6) AS precision_at_10pct, count(*) AS k FROM r WHERE rk <= ceil(0.1 * n)""")
def precision_at_10pct(spark, d):
    """Global rank by score (distributed) compared to ceil(0.1 n) from a scalar subquery."""
    s = _scored(spark, d)
    n = s.select(F.ceil(F.count(F.lit(1)) * 0.1)).scalar()
    r = global_rank(s.select("id", "label", (-F.col("score")).alias("_ns")), ["_ns", "id"], out_col="rk")
    top = r.filter(F.col("rk") <= n)
    return top.agg(F.round(F.avg("label"), 6).alias("precision_at_10pct"), F.count(F.lit(1)).alias("k"))


CHUNK_SQL = """
WITH t AS (SELECT s.doc_id, s.label, len(regexp_extract_all(c.code, '\\w+|[^\\w\\s]', 0)) AS n
           FROM v_scored s JOIN v_corpus c ON c.ordinal = s.doc_id),
k AS (SELECT *, CASE WHEN n <= 510 THEN 1 ELSE 1 + CAST(ceil((n - 510) / 256) AS INTEGER) END AS k FROM t),
w AS (SELECT doc_id, label, g.i AS chunk_idx FROM k, range(0, k) AS g(i))
"""


def _chunk_score_sql():
    return ("CAST(0.3 AS DOUBLE) * label + CAST(0.7 AS DOUBLE) * CAST((doc_id * 7919 + chunk_idx * 31) % 1000 AS DOUBLE)"
            " / CAST(1000.0 AS DOUBLE)")


@register("max_over_windows", CHUNK_SQL + f"""
SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS id, count(*) AS n_chunks, round(max({_chunk_score_sql()}), 4) AS score
FROM w GROUP BY doc_id""")
def max_over_windows(spark, d):
    """Record score = max chunk score (rounded to 4) over its token windows."""
    from ..functions import text as TX
    from ..operators import corpus as C
    s = V.v_scored(spark, d).select("doc_id", "label")
    c = V.v_corpus(spark, d).select(F.col("ordinal").alias("doc_id"), TX.regex_tokens("code").alias("tokens"))
    w = C.token_windows(s.join(c, "doc_id"), "tokens", 510, 256)
    sc = (F.lit(0.3) * F.col("label") + F.lit(0.7) * ((F.col("doc_id") * 7919 + F.col("chunk_idx") * 31) % 1000).cast("double")
          / F.lit(1000.0))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.max(sc), 4).alias("score")).select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), "n_chunks", "score")


def _round_sql(i: int, before: str) -> str:
    """CTEs of one round: the best weights at the threshold in ``before``, then the best threshold."""
    grid = metrics_sql(f"""SELECT vid, w1, w2, w3, w4, count_if(f AND label = 1) AS tp, count_if(f AND label <> 1) AS fp,
      count_if(NOT f AND label = 1) AS fn, count_if(NOT f AND label <> 1) AS tn
      FROM (SELECT wv.*, s.label, wv.w1 * s.s1 + wv.w2 * s.s2 + wv.w3 * s.s3 + wv.w4 * s.s4 >= b.threshold AS f
            FROM {_VEC_SQL} JOIN v_scored s ON TRUE JOIN {before} b ON TRUE) x GROUP BY vid, w1, w2, w3, w4""")
    sweep = metrics_sql(f"""SELECT g.threshold, count_if(v.vote >= g.threshold AND v.label = 1) AS tp, count_if(v.vote >= g.threshold AND v.label <> 1) AS fp,
      count_if(NOT (v.vote >= g.threshold) AND v.label = 1) AS fn, count_if(NOT (v.vote >= g.threshold) AND v.label <> 1) AS tn
      FROM {_grid_sql(EV.SWEEP_GRID).replace(') AS t(threshold)', ') AS g(threshold)')}
      JOIN (SELECT s.label, t.w1 * s.s1 + t.w2 * s.s2 + t.w3 * s.s3 + t.w4 * s.s4 AS vote FROM v_scored s JOIN t{i} t ON TRUE) v ON TRUE
      GROUP BY g.threshold""")
    return f"""t{i} AS MATERIALIZED (SELECT w1, w2, w3, w4 FROM ({grid}) q ORDER BY f1 DESC, vid LIMIT 1),
r{i} AS MATERIALIZED (SELECT {i} AS round, t.w1, t.w2, t.w3, t.w4, q.threshold, q.f1 FROM (SELECT threshold, f1 FROM ({sweep}) z ORDER BY f1 DESC, threshold LIMIT 1) q JOIN t{i} t ON TRUE)"""


@register("joint_optimise", f"""
WITH r0 AS (SELECT 0.5::DOUBLE AS threshold), {_round_sql(1, 'r0')}, {_round_sql(2, 'r1')}, {_round_sql(3, 'r2')}
SELECT * FROM r1 UNION ALL SELECT * FROM r2
UNION ALL SELECT r3.* FROM r3 JOIN r2 ON TRUE JOIN r1 ON TRUE WHERE r2.f1 - r1.f1 >= 1e-4""")
def joint_optimise(spark, d, rounds: int = 3, tol: float = 1e-4):
    """Alternate weight grid (at the current threshold) and threshold sweep
    (at the current weights) until the F1 gain is below ``tol``."""
    s = V.v_scored(spark, d).select("label", "s1", "s2", "s3", "s4")
    return EV.joint_optimise(s, ["s1", "s2", "s3", "s4"], rounds, tol)

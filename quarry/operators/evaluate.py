"""Evaluation: confusion, metrics, AUC, sweeps, grids, per-category quality.

Everything reduces the scored rows once into small count tables (by
threshold bucket, by distinct score, by grid cell) and derives metrics from
those; no operator re-scans the rows per threshold or joins rows to grids.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .helpers import bucket_sweep, grid_bucket, ordered_scan


def linspace(lo: float, hi: float, n: int) -> list[float]:
    return [round(lo + (hi - lo) * i / (n - 1), 6) for i in range(n)]


def frange(lo: float, hi: float, step: float) -> list[float]:
    n = int(round((hi - lo) / step)) + 1
    return [round(lo + i * step, 6) for i in range(n)]


SWEEP_GRID = linspace(0.15, 0.85, 200)


def _div(a: Column, b: Column) -> Column:
    """a / b with 0 on zero division (ANSI safe)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.when(b == 0, F.lit(1)).otherwise(b).cast("double"))


def flag(score: str = "score", threshold: float = 0.5, inclusive: bool = True) -> Column:
    return F.col(score) >= threshold if inclusive else F.col(score) > threshold


def confusion(df: DataFrame, pred: Column, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    y = F.col(label) == 1
    return df.groupBy(*by).agg(
        F.count_if(~pred & ~y).alias("tn"), F.count_if(pred & ~y).alias("fp"),
        F.count_if(~pred & y).alias("fn"), F.count_if(pred & y).alias("tp"))


def with_metrics(c: DataFrame) -> DataFrame:
    """Precision, recall, F1 (0 on zero division), specificity, FPR, FNR from tn/fp/fn/tp."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p = _div(tp, tp + fp)
    r = _div(tp, tp + fn)
    out = c.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when((F.col("precision") + F.col("recall")) == 0, F.lit(0.0)).otherwise(
        F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return (out.withColumn("f1", f1).withColumn("specificity", _div(tn, tn + fp))
            .withColumn("fpr", _div(fp, fp + tn)).withColumn("fnr", _div(fn, fn + tp)))


def score_levels(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row per distinct score: positives and negatives at that score."""
    return df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Tie-aware rank AUC (Mann-Whitney); 0.0 when one class is absent.

    Negatives below each distinct score come from a distributed running sum
    over the distinct scores (range-partitioned scan, no global window)."""
    lv = score_levels(df, score, label)
    lv = ordered_scan(lv, [score], "neg", out_col="neg_below", inclusive=False)
    wide = lambda c: F.col(c).cast("decimal(38,0)")  # noqa: E731  products of two counts leave 64 bits
    agg = lv.agg(F.sum(wide("pos") * (wide("neg_below") * 2 + wide("neg"))).cast("double").alias("num2"),
                 F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    den = F.col("P").cast("double") * F.col("N").cast("double") * 2
    return agg.select(F.when(den == 0, F.lit(0.0)).otherwise(F.col("num2") / F.when(den == 0, 1.0).otherwise(den)).alias("roc_auc"),
                      F.col("P").alias("n_pos"), F.col("N").alias("n_neg"))


def pr_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Average precision: sum over distinct scores (descending) of pos_s * precision_s / P."""
    lv = score_levels(df, score, label).withColumn("_ns", -F.col(score))
    lv = ordered_scan(lv, ["_ns"], ["pos", "neg"], out_col=["tp_cum", "fp_cum"])
    term = F.col("pos") * (F.col("tp_cum") / (F.col("tp_cum") + F.col("fp_cum")))
    agg = lv.agg(F.sum(term).alias("_s"), F.sum("pos").alias("_P"))
    return agg.select(F.when(F.col("_P") == 0, F.lit(0.0)).otherwise(F.round(F.col("_s") / F.col("_P"), 6)).alias("pr_auc"))


def threshold_sweep(df: DataFrame, grid: Sequence[float] = SWEEP_GRID, score="score", label="label",
                    inclusive: bool = True, by: Sequence[str] = ()) -> DataFrame:
    return with_metrics(bucket_sweep(df, grid, score, label, inclusive, by))


def pick_threshold(sweep: DataFrame, recall_floor: float = 0.75) -> DataFrame:
    """best_f1: max F1, lowest threshold on ties; recall_biased: lowest threshold
    with recall >= floor, else best_f1."""
    best = sweep.agg(F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold"))).alias("b"),
                     F.min(F.when(F.col("recall") >= recall_floor, F.col("threshold"))).alias("rb"))
    return best.select(F.col("b.threshold").alias("best_f1_threshold"), F.col("b.f1").alias("best_f1"),
                       F.coalesce("rb", F.col("b.threshold")).alias("recall_biased_threshold"))


def weight_vectors(step: float = 0.05, k: int = 4) -> list[tuple[float, ...]]:
    n = int(round(1 / step))
    out = []
    for ks in product(range(1, n + 1), repeat=k - 1):
        last = n - sum(ks)
        if last >= 1:
            out.append(tuple(round(x * step, 2) for x in (*ks, last)))
    return out


def weight_grid(df: DataFrame, members: Sequence[str], threshold: float = 0.5, step: float = 0.05,
                label: str = "label") -> DataFrame:
    """F1 at ``threshold`` for every weight vector (>= step each, summing to 1).

    Rows are reduced to counts of distinct (label, scores) first, which is exact;
    each of those meets the fixed vectors, and the (vector) sums are reduced
    map-side before a tiny shuffle."""
    vecs = weight_vectors(step, len(members))
    arr = F.array(*[F.array(*[F.lit(w) for w in v]) for v in vecs])
    # explode the (fixed) vectors first so the vote is a plain, code-generated projection
    distinct = df.groupBy(F.col(label).alias("_y"), *members).agg(F.count(F.lit(1)).alias("_n"))
    rows = distinct.select("_y", "_n", *members, F.posexplode(arr).alias("vid", "_w"))
    vote = None
    for i, m in enumerate(members):
        t = F.get("_w", i) * F.col(m)
        vote = t if vote is None else vote + t
    flags = rows.select("_n", (F.col("_y") == 1).alias("_p"), "vid", (vote >= threshold).alias("_f"))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0)).cast("long")
    f, p = F.col("_f"), F.coalesce("_p", F.lit(False))
    c = flags.groupBy("vid").agg(n(f & p).alias("tp"), n(f & ~p).alias("fp"), n(~f & p).alias("fn"), n(~f & ~p).alias("tn"))
    spark = df.sparkSession
    vdf = spark.createDataFrame([(i, *v) for i, v in enumerate(vecs)],
                                "vid int, " + ", ".join(f"w{i + 1} double" for i in range(len(members))))
    return with_metrics(c).join(F.broadcast(vdf), "vid")


def gate_grid(df: DataFrame, s1: str, s2: str, g1: Sequence[float], g2: Sequence[float], label: str = "label") -> DataFrame:
    """Two-stage AND gate at every (t1, t2): 2-D bucket counts, then 2-D suffix sums."""
    b = df.select(grid_bucket(F.col(s1), g1).alias("b1"), grid_bucket(F.col(s2), g2).alias("b2"), F.col(label).alias("_y"))
    cnt = b.groupBy("b1", "b2").agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") != 1).alias("neg"))
    tot = cnt.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    cells = (cnt.filter((F.col("b1") >= 1) & (F.col("b2") >= 1))
             .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("b1"))))
             .withColumn("j", F.explode(F.sequence(F.lit(1), F.col("b2"))))
             .groupBy("i", "j").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp")))
    ga = F.array(*[F.lit(float(t)) for t in g1])
    gb = F.array(*[F.lit(float(t)) for t in g2])
    frame = (tot.select("P", "N", F.posexplode(ga).alias("i0", "t1"))
             .select("P", "N", "i0", "t1", F.posexplode(gb).alias("j0", "t2"))
             .withColumn("i", F.col("i0") + 1).withColumn("j", F.col("j0") + 1))
    j = frame.join(cells, ["i", "j"], "left")
    tp = F.coalesce("tp", F.lit(0)).cast("long")
    fp = F.coalesce("fp", F.lit(0)).cast("long")
    out = j.select("t1", "t2", tp.alias("tp"), fp.alias("fp"), (F.col("P") - tp).alias("fn"), (F.col("N") - fp).alias("tn"))
    return with_metrics(out)


def brier(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    e = F.col(score) - F.col(label)
    return df.agg(F.round(F.avg(e * e), 6).alias("brier"))


def class_metrics(df: DataFrame, pred: Column, label: str = "label") -> DataFrame:
    """Precision and recall of both classes, from one confusion row."""
    c = confusion(df, pred, label)
    row = lambda k, hit, p, r: F.struct(F.lit(k).alias("class"), _div(F.col(hit), F.col(hit) + F.col(p)).alias("precision"), _div(F.col(hit), F.col(hit) + F.col(r)).alias("recall"))
    return c.select(F.inline(F.array(row(0, "tn", "fn", "fp"), row(1, "tp", "fp", "fn"))))


def metrics_by_category(df: DataFrame, pred: Column, category: str = "category", label: str = "label", unknown: str = "Unknown") -> DataFrame:
    s = df.withColumn(category, F.coalesce(category, F.lit(unknown)))
    c = confusion(s, pred, label, by=[category])
    return with_metrics(c.withColumn("n", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")))


def metrics_delta(df: DataFrame, pred_a: Column, pred_b: Column, label: str = "label") -> DataFrame:
    """Change of precision, recall and F1 from run a to run b, in one pass."""
    s = df.select(label, F.inline(F.array(F.struct(F.lit("a").alias("run"), pred_a.alias("_f")), F.struct(F.lit("b").alias("run"), pred_b.alias("_f")))))
    m = with_metrics(confusion(s, F.col("_f"), label, by=["run"]))
    long = m.select("run", F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("v")) for k in ("precision", "recall", "f1")])))
    w = long.groupBy("metric").agg(*[F.max(F.when(F.col("run") == r, F.col("v"))).alias(f"run_{r}") for r in "ab"])
    delta = F.col("run_b") - F.col("run_a")
    return w.withColumn("delta", delta).withColumn("pct", F.when(F.col("run_a") != 0, F.round(delta / F.col("run_a") * 100.0, 6)))


def noise_weights(df: DataFrame, score: str = "score", label: str = "label", hi: float = 0.8, lo: float = 0.2, weight: float = 0.3) -> DataFrame:
    """Weight of each row and whether its label contradicts a sure score."""
    noise = ((F.col(label) == 0) & (F.col(score) > hi)) | ((F.col(label) == 1) & (F.col(score) < lo))
    return df.withColumn("weight", F.when(noise, weight).otherwise(1.0)).withColumn("is_noise", noise)


def review_list(df: DataFrame, score: str = "score", label: str = "label", n: int = 50, key: str = "id") -> DataFrame:
    """The rows to look at by hand: noisy ones, the surest contradiction first."""
    noisy = noise_weights(df, score, label).filter("is_noise")
    gap = F.abs(F.col(score) - F.col(label))
    return noisy.withColumn("gap", gap).orderBy(F.desc("gap"), key).limit(n)


def triage_flags(m: DataFrame) -> DataFrame:
    """Advice per row from precision/recall/F1 thresholds."""
    adv = F.array_compact(F.array(
        F.when(F.col("precision") < 0.5, F.lit("low precision: many false positives")),
        F.when(F.col("recall") < 0.6, F.lit("low recall: many missed vulnerabilities")),
        F.when(F.col("f1") < 0.5, F.lit("weak overall: consider more data or features")),
        F.when(F.col("f1") >= 0.7, F.lit("strong category")),
    ))
    return m.withColumn("advice", adv)


def focal_loss(df: DataFrame, score="score", label="label", gamma: float = 2.0, alpha: float = 0.75) -> Column:
    p = F.least(F.greatest(F.col(score), F.lit(1e-7)), F.lit(1 - 1e-7))
    pos = -F.lit(alpha) * F.pow(F.lit(1.0) - p, gamma) * F.log(p)
    neg = -F.lit(1 - alpha) * F.pow(p, gamma) * F.log(F.lit(1.0) - p)
    return F.when(F.col(label) == 1, pos).otherwise(neg)


def weighted_ce(score="score", label="label", w_pos: Column | float = 1.0, w_neg: Column | float = 1.0) -> Column:
    p = F.least(F.greatest(F.col(score), F.lit(1e-7)), F.lit(1 - 1e-7))
    wp = w_pos if isinstance(w_pos, Column) else F.lit(w_pos)
    wn = w_neg if isinstance(w_neg, Column) else F.lit(w_neg)
    return F.when(F.col(label) == 1, -wp * F.log(p)).otherwise(-wn * F.log(F.lit(1.0) - p))


def running_rank(df: DataFrame, score: str = "score") -> DataFrame:
    """Average rank with ties (1-based), via counts below each distinct score."""
    lv = df.groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    lv = ordered_scan(lv, [score], "_n", out_col="_below", inclusive=False)
    lv = lv.select(score, (F.col("_below") + (F.col("_n") + 1) / 2.0).alias("avg_rank"))
    return df.join(lv, score, "inner")


def joint_optimise(df: DataFrame, members: Sequence[str], rounds: int = 3, tol: float = 1e-4) -> DataFrame:
    """Alternate the weight grid (at the current threshold) and the threshold sweep (at the
    current weights) until the gain in F1 is below ``tol``; one row a round.

    Rows stay distributed; the grid's best row and the sweep's come to the driver."""
    thr, best, hist = 0.5, -1.0, []
    for r in range(rounds):
        top = weight_grid(df, members, threshold=thr).orderBy(F.desc("f1"), "vid").first()
        weights = [top[f"w{i + 1}"] for i in range(len(members))]
        vote = None
        for w, m in zip(weights, members):
            vote = F.lit(w) * F.col(m) if vote is None else vote + F.lit(w) * F.col(m)
        found = pick_threshold(threshold_sweep(df.withColumn("score", vote))).first()
        gain, thr, best = found.best_f1 - best, found.best_f1_threshold, found.best_f1
        hist.append((r + 1, *weights, float(thr), float(best)))
        if gain < tol:
            break
    cols = ", ".join(f"w{i + 1} double" for i in range(len(members)))
    return df.sparkSession.createDataFrame(hist, f"round int, {cols}, threshold double, f1 double")

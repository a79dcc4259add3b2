"""Plan-level checks: no cross joins anywhere, hot keys split, scans pruned."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators import corpus as C
from quarry.operators import helpers as H
from quarry.operators.helpers import bucketed_range_join
from quarry.plans.registry import queries
from tests.conftest import SF

# queries whose construction runs writes, streams or model fits are covered by other tests
SIDE_EFFECTS = {n for n in queries() if "roundtrip" in n or n.startswith("stream_")} | {
    "validate_corpus", "corpus_verdicts", "joint_optimise", "pca_embeddings", "ensemble_predictions", "stacked_predictions",
    "feature_importance", "fp_drivers"}
NAMES = sorted(n for n in queries() if n not in SIDE_EFFECTS)


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_join(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_flagship_scan_is_pruned(spark):
    plan = queries()["corpus_label_mix"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in plan
    assert "ReadSchema: struct<doc_id:bigint,toxic:int>" in plan


def test_hot_key_is_split_across_buckets(spark):
    # one key holds a third of the rows
    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        (F.col("id") % 50).cast("string")).alias("k"), "id", (F.col("id") % 7).alias("v"))
    cut = H._bucketed(df, ["k"], ["id"], 6)
    parts = cut.groupBy(H._B).count().collect()
    assert len(parts) == 6 and max(r["count"] for r in parts) < 1000  # 500 each, were the bounds exact
    assert cut.filter("k = 'hot'").select(H._B).distinct().count() >= 2
    got = H.ordered_scan(df, ["id"], "v", ["k"], "c", num_partitions=6)
    ref = df.withColumn("r", F.sum("v").over(W.partitionBy("k").orderBy("id").rowsBetween(W.unboundedPreceding, 0)))
    assert got.join(ref, ["k", "id"]).filter("c != r").count() == 0


def test_null_keys(spark):
    for key in (F.when(F.col("id") % 5 == 0, F.col("id") % 3), F.when(F.col("id") % 5 == 0, (F.col("id") % 3).cast("string"))):
        df = spark.range(0, 1000).select(key.alias("k"), "id", F.when(F.col("id") % 4 == 0, F.col("id")).alias("v"))
        w = W.partitionBy("k").orderBy("id")
        got = H.global_rank(df, ["id"], ["k"], num_partitions=7).join(df.select("id", F.row_number().over(w).alias("r")), "id")
        assert got.filter("rank != r").count() == 0 and got.filter("k IS NULL").agg(F.max("rank")).first()[0] == 800
        fill = H.ordered_fill(df, ["id"], "v", ["k"], "p", "n", 7)
        ref = df.select("id", F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("rp"),
                        F.first("v", True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("rn"))
        assert fill.join(ref, "id").filter("NOT (p <=> rp) OR NOT (n <=> rn)").count() == 0
        split = C.stratified_split(df, ["k"], "id").groupBy("k", "split").count().collect()
        sizes = {(r.k, r.split): r["count"] for r in split}
        assert [sizes[None, s] for s in ("train", "val", "test")] == [640, 80, 80]


def test_sampling_plans_have_no_python(spark):
    for name in ("undersample", "stratified_split", "category_sample", "map_findings", "log_tail"):
        plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan, name


def test_segmentation_does_not_shuffle(spark):
    plan = queries()["segment_units"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_range_join_first_containing_unit(spark):
    units = spark.createDataFrame([("a", "f", 1, 100), ("b", "f", 10, 20), ("c", "f", 15, 300)],
                                  "uid string, file_path string, start_line long, end_line long")
    pts = spark.createDataFrame([(1, "f", 16), (2, "f", 150), (3, "g", 5)], "finding_id long, file_path string, line long")
    hits = bucketed_range_join(pts, units, "file_path", "line", "start_line", "end_line", bucket=8)
    first = hits.groupBy("finding_id").agg(F.min_by("uid", F.struct("start_line", "uid")).alias("uid"))
    assert {r.finding_id: r.uid for r in first.collect()} == {1: "a", 2: "c"}


def test_ties_in_the_first_order_column_are_spread(spark):
    # a million rows of one confidence
    df = spark.range(0, 1_000_000).select(F.lit(0.5).alias("c"), "id")
    parts = H._bucketed(df, [], ["c", "id"], 16).groupBy(H._B).count().collect()
    assert len(parts) == 16 and max(r["count"] for r in parts) < 150_000
    got = H.global_rank(df, ["c", "id"], num_partitions=16)
    assert got.filter("rank != id + 1").count() == 0


def test_fill_takes_time_in_proportion(spark):
    import time
    took = []
    for n in (20_000, 160_000):
        df = spark.range(n).select("id", F.when(F.col("id") % 100 == 7, F.col("id")).alias("v")).coalesce(2)
        t = time.time()
        got = H.ordered_fill(df, ["id"], "v", num_partitions=2)
        bad = got.filter(~(F.col("_prev").eqNullSafe(F.when(F.col("id") >= 7, F.col("id") - F.pmod(F.col("id") - 7, F.lit(100)))))).count()
        took.append(time.time() - t)
        assert bad == 0
    assert took[1] < 5 * took[0] + 3


def test_a_long_unit_is_two_rows(spark):
    units = spark.createDataFrame([("a", "f", 1, 1_000_000), ("b", "f", -5, 3), ("c", "f", 999_999, 1_000_001), ("d", "f", 7, 6), ("e", "f", 2**40, 2**40)],
                                  "uid string, file_path string, start_line long, end_line long")
    pts = spark.createDataFrame([(i, "f", p) for i, p in enumerate([0, 1, 4, 1_000_000, 2_000_000, -5, -6, 2**40])], "finding_id long, file_path string, line long")
    hits = bucketed_range_join(pts, units, "file_path", "line", "start_line", "end_line", bucket=8)
    assert sorted((r.finding_id, r.uid) for r in hits.collect()) == [(0, "b"), (1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "c"), (5, "b"), (7, "e")]
    assert H._blocks(units, "start_line", "end_line", 8).groupBy("uid").count().agg(F.max("count")).first()[0] <= 2


def test_mapping_runs_the_range_join_once(spark):
    """The range join is computed by the one write before the fill; the plan that is left has none."""
    from quarry.operators import findings as FD
    units = spark.createDataFrame([("u", "f", 3, 9)], "uid string, file_path string, start_line long, end_line long")
    found = spark.createDataFrame([(1, "f", 4), (2, "f", 1)], "finding_id long, file_path string, line long")
    m = FD.map_findings(found, units)
    assert "_q_w" not in m._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, m.collect())) == [(1, "u", "contained"), (2, "u", "nearest")]

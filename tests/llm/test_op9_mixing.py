import math

from pyspark.sql import functions as F

from quarry.llm import mixing as M


def make(spark, n=4000):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < n * 3 // 4, "big").when(F.col("id") % 2 == 0, "small").alias("source"))


def test_counts_follow_the_distribution(spark):
    d = make(spark)
    out = M.mix_sources(d, weights={"big": 1.0, "small": 2.0, None: 0.0}, total=6000)
    rows = out.groupBy("source", "doc_id").count().collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r["count"])
    assert None not in by  # weight 0
    for s, n, rate in (("big", 3000, 2000 / 3000), ("small", 500, 4000 / 500)):
        total = sum(by[s])
        assert abs(total - rate * n) < 5 * math.sqrt(rate * n)
        never = n - len(by[s])
        assert abs(never / n - math.exp(-rate)) < 0.04


def test_same_draws_whatever_the_partitions(spark):
    d = make(spark, 500)
    key = lambda x: sorted(map(tuple, M.mix_sources(x).select("doc_id", "copy_no").collect()))
    assert key(d.repartition(3)) == key(d.repartition(7, "source"))


def test_high_rate_nulls_repeats_clashes(spark):
    d = spark.createDataFrame([(1, None, "a", 9), (1, None, "a", 9), (None, "x", None, 9)], "doc_id long, text string, source string, rate long")
    rows = M.mix_sources(d, weights={"a": 1.0, None: 1.0}, total=2000).collect()
    n = [sum(r.source == s for r in rows) for s in ("a", None)]
    assert n[0] % 2 == 0 and 800 < n[0] < 1200 and 800 < n[1] < 1200
    assert {r.rate for r in rows} == {500.0, 1000.0}
    assert M.mix_sources(d.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = M.mix_sources(make(spark, 10))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan

"""Tree ensembles as node tables: scores and attributions against MLlib and a walk by hand."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from quarry.operators import corpus as C
from quarry.operators import scoring as SC
from quarry.operators import trees as TR


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(3)
    rows = [(i, Vectors.dense(rng.normal(size=4).round(1).tolist()), 0) for i in range(400)]
    df = spark.createDataFrame([(i, x, int(x[0] + 0.5 * x[2] > 0.2 * (i % 3))) for i, x, _ in rows], ["vec_id", "features", "label"])
    models = SC.fit_members(df, only=list(SC.MEMBER_WEIGHTS))
    return df, models, {name: TR.tree_nodes(spark, m) for name, m in models.items()}


def by_hand(nodes, x):
    """Sum over trees of weight times leaf value, and the changes on the way, one row at a time."""
    score, base, parts = 0.0, 0.0, [0.0] * len(x)
    for tree in {n.tree for n in nodes}:
        of = {n.node: n for n in nodes if n.tree == tree}
        n = of[0]
        base += n.weight * n.value
        while n.left >= 0:
            m = of[n.left if x[n.feature] <= n.threshold else n.right]
            parts[n.feature] += n.weight * (m.value - n.value)
            n = m
        score += n.weight * n.value
    return base, score, parts


@pytest.mark.parametrize("name", list(SC.MEMBER_WEIGHTS))
def test_scores_and_attributions(fitted, name):
    df, models, nodes = fitted
    scored = SC.member_scores(df, {name: models[name]})
    out = TR.attributions(scored, nodes[name]).withColumn("x", vector_to_array("features"))
    out = out.withColumn("p", TR.probability(F.col("path.score"), name.startswith("gbt"))).collect()
    table = nodes[name].collect()
    for r in out[:40]:
        base, score, parts = by_hand(table, r.x)
        assert np.allclose([r.path.base, r.path.score, *r.path.contributions], [base, score, *parts], atol=1e-12)
    for r in out:
        assert abs(r.path.base + sum(r.path.contributions) - r.path.score) < 1e-9
        assert abs(r.p - r[f"p_{name}"]) < 1e-9


def test_no_rows(fitted):
    df, _, nodes = fitted
    assert TR.attributions(df.limit(0), nodes["gbt"]).collect() == []


def test_false_positive_drivers(spark):
    rows = [(0, True, [0.3, -0.2, 0.1]), (0, True, [0.0, 0.5, 0.6]), (1, True, [9.0, 9.0, 9.0]), (0, False, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "label int, is_vulnerable boolean, contributions array<double>")
    got = {r.feature: (r.n_fp_top, r.share) for r in SC.fp_drivers(df, k=1).collect()}
    assert got == {0: (1, 0.5), 2: (1, 0.5)}


def test_nested_keys_are_not_the_record_s(spark):
    record = '{"id":"1","dataset":"d","language":"c","meta":{"label_binary":7,"code":5},"code":"int a;","label_binary":%s,"label_cwe":null,"label_cve":null}'
    lines = [record % "1", record % '"1"', record % "true", record % "null", '{"meta":{"code":"x"},"id":"1","dataset":"d","language":"c","code":3,"label_binary":0,"label_cwe":null,"label_cve":null}']
    got = {r.value: (r.error, r.label) for r in C.validate_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert [got[x][0] for x in lines] == [None, "invalid_label_1", None, "invalid_label_None", "empty_code"]
    assert got[lines[0]][1] == 1

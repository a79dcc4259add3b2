import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quarry.llm import decontaminate as D
from quarry.llm import language_cnn as L
from quarry.llm import mixing as M
from quarry.llm import pii_crf as C
from tests.conftest import SF
from tests.llm.test_op5_join import brute as components
from tests.llm.test_op10_decontaminate import brute_lcs_share


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """What every stage is given and returns."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (a, b) for name, a, b in out}


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(staged):
    for name, (a, b) in staged.items():
        assert b.columns[: len(a.columns)] == a.columns
        assert name == "mixing" or a.columns == b.columns


def test_language(staged):
    a, b = staged["language"]
    lang, score, _ = L.identify(L.fit_languages(a), [r.text for r in a.orderBy("doc_id").collect()])
    assert ids(b) == [i for i, x, s in zip(ids(a), lang, score) if x != "und" and s >= L.MIN_SCORE]


def test_near_duplicates(staged):
    a, b = staged["near_duplicates"]
    label = components({r.doc_id: r.text for r in a.collect()})
    assert ids(b) == sorted({c for _, c in label.values()})


def test_decontamination(spark, staged):
    a, b = staged["decontamination"]
    items = [D.tokens(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    share = {r.doc_id: max((brute_lcs_share(x, D.tokens(r.text.encode())) for x in items if len(x) >= D.MIN_WORDS), default=0) for r in a.collect()}
    kept = set(ids(b))
    assert not [i for i in kept if share[i] >= 0.75]
    assert not [i for i in share if i not in kept and share[i] < 0.5]
    assert len(kept) < len(share)


def test_personal_data(staged):
    a, b = staged["personal_data"]
    before = {r.doc_id: r for r in a.collect()}
    after = {r.doc_id: r for r in b.collect()}
    assert before.keys() == after.keys()
    changed = 0
    for i, r in after.items():
        assert not [m for m in C.matches(r.text) if m[3]]
        if r.text != before[i].text:
            changed += 1
            assert any("[" + k.upper() + "]" in r.text for k in C.KINDS) and r.n_chars == len(r.text)
        else:
            assert r == before[i]
    assert changed


def test_mixing(staged):
    a, b = staged["mixing"]
    rows = a.withColumn("u", M.uniform(42, F.col("doc_id"), F.lit(0))).collect()
    n = Counter(r.source for r in rows)
    raw = sum(math.sqrt(x) for x in n.values())
    want = Counter()
    for r in rows:
        rate = math.sqrt(n[r.source]) / raw * len(rows) / n[r.source]
        p = cdf = math.exp(-rate)
        k = 0
        while cdf < r.u:
            k += 1
            p *= rate / k
            cdf += p
        if k:
            want[r.doc_id] = k
    assert Counter(ids(b)) == want


def test_run_is_the_stages_in_order(spark, staged):
    assert sorted(map(str, P.run(spark, SF).collect())) == sorted(map(str, staged["mixing"][1].collect()))


def test_edge_rows(spark):
    """Nulls, empty and repeated rows, extra columns with clashing names, an empty table."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(900, None, None, None, None), (901, "", "en", None, 0), (None, "the of and that with", "en", "s", 20), (902, "the one of the others and that", "en", None, 30), (902, "the one of the others and that", "en", None, 30)], base.schema)
    docs = base.unionByName(odd)
    for extra in ("copy_no", "label", "component_id", "key", "n", "rate"):
        docs = docs.withColumn(extra, F.lit("x"))
    for name, f in P.STAGES:
        docs = f(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() > 0
    assert docs.filter("doc_id IS NULL OR doc_id = 902").groupBy("doc_id").count().count() <= 2
    empty = base.limit(0)
    for name, f in P.STAGES:
        assert f(spark, empty, SF).collect() == []

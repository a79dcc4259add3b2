import re

import numpy as np
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import repetition as R
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, min_repeat=R.MIN_REPEAT):
    w = WORD.findall(text or "")
    n = len(w)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and w[i + k] == w[j + k]:
                    k += 1
                best[i] = max(best[i], k)
    cover = lambda m: len({p for i in range(n) if best[i] >= m for p in range(i, i + best[i])})
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    three = [tuple(w[i : i + 3]) for i in range(n - 2)]
    rep = {i + d for i, t in enumerate(three) if three.count(t) > 1 for d in range(3)}
    failed = n < 50 or 100 * len(rep) > 50 * n
    longest = max([b for b in best if b >= min_repeat], default=0)
    covered = cover(min_repeat)
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(rep),
            "base_failed": failed, "covered_words": covered, "longest_repeat": longest, "kept": not failed and covered <= R.MAX_COVERED * n and longest <= R.MAX_LONGEST}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_suffix_array(xs):
    seq = np.array(xs, np.int64)
    sa, lcp = R.suffix_array_lcp(seq)
    assert sa.tolist() == sorted(range(len(xs)), key=lambda i: xs[i:])
    for r in range(1, len(xs)):
        a, b = xs[sa[r - 1] :], xs[sa[r] :]
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        assert lcp[r] == k


def test_against_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    got = {r.doc_id: r.asDict() for r in R.op1_suffix_repetition(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i in sorted(texts)[:60]:
        if len(texts[i]) < 4000:
            want = brute(texts[i])
            assert {k: got[i][k] for k in want} == want, i


def test_edge_cases(docs):
    line = " ".join(f"w{i}" for i in range(30))
    texts = [None, "", " \t\n", line + "\n" + line + "\n" + " ".join(f"u{i}" for i in range(200)), "é # a\n\na", "a " * 60, "x" * 300_000, line + "\n" + line]
    rows = R.text_repetition(docs(texts + texts[:1]).withColumn("kept", F.lit(1))).orderBy("doc_id").collect()
    assert len(rows) == len(texts) + 1
    for r, t in zip(rows, texts):
        want = brute(t)
        assert {k: r[k] for k in want} == want
    assert rows[3].kept and [tuple(x) for x in rows[3].repeat_spans] == [(0, 60)]


def test_empty_table(docs, spark):
    assert R.text_repetition(docs(["a"]).limit(0)).collect() == []

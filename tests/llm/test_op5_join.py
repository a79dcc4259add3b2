import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import jaccard_join as J
from quarry.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                i, j = sorted((find(a), find(b)))
                label[j] = i
    return {i: (len(sets[i]), find(i)) for i in ids}


def run(spark, texts, partitions=5):
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("sig", F.lit("x")).withColumn("n", F.lit(1)).repartition(partitions)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.shingle_components(d).collect()}


def test_families_and_large_blocks(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = {}
    common = [word() for _ in range(70)]  # a passage that many share
    for family, size, swaps in ((0, 150, 4), (1, 40, 1), (2, 12, 2), (3, 3, 0)):
        base = [word() for _ in range(100)]
        for k in range(size):
            w = list(base)
            for _ in range(rng.randint(0, swaps)):
                w[rng.randrange(100)] = word()
            texts[family * 1000 + k] = " ".join(w)
    for k in range(120):
        texts[5000 + k] = " ".join(common + [word() for _ in range(rng.choice([2, 5, 20, 200]))])
    for k in range(30):
        texts[6000 + k] = " ".join(word() for _ in range(rng.randrange(1, 12)))
        texts[7000 + k] = texts[6000 + k].upper() if k % 2 else texts[6000 + k] + " more"
    texts |= {8000: None, 8001: "", 8002: " \n", 8003: "a", 8004: "A", 8005: "a b", 8006: " ".join(word() for _ in range(30_000)), 8007: "x " * 500}
    texts[8008] = texts[8006] + " end"
    assert run(spark, texts) == brute(texts)


def test_rest_of_a_block_is_searched(spark):
    """Two interleaved families in the same blocks: links among points behind the first."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(60)]
    tails = [[word() for _ in range(22)] for _ in range(40)]
    texts = {}
    for k in range(200):  # 56 of about 78 shingles shared by all: blocks hold all 40 families
        w = base + tails[k % 40]
        texts[k] = " ".join(w) + (f" u{k}" if k >= 40 else "")
    assert run(spark, texts) == brute(texts)


def test_nulls_and_repeated_rows(spark):
    t = "one two three four five six seven"
    d = spark.createDataFrame([(1, t), (1, t), (None, t), (None, None), (2, t), (3, None)], "doc_id long, text string")
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in J.shingle_components(d).collect())
    assert rows == [(False, 1, 3, 1), (False, 1, 3, 1), (False, 2, 3, 1), (False, 3, 0, 3), (True, 0, 0, None), (True, 0, 3, None)]
    assert J.shingle_components(d.limit(0)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 90))
def test_tree_loses_no_link(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = []
    for _ in range(n):
        k = int(rng.integers(1, 120))
        s = base[:k][rng.random(k) < rng.choice([0.7, 0.95])]
        sets.append(np.unique(np.concatenate([s, rng.integers(0, 2**63, int(rng.integers(1, 8)), dtype=np.uint64)])))
    sizes, vecs = np.array([len(s) for s in sets]), [J.count_vector(s).tobytes() for s in sets]
    f = J.Forest(np.arange(n), sizes, vecs)
    q, p = f.search(sizes, vecs)
    got = set(zip(q.tolist(), p.tolist()))
    a, b = J.leaf_pairs(np.array([0]), np.array([n]), sizes, vecs)
    leaf = set(zip(a.tolist(), b.tolist()))
    for i in range(n):
        for j in range(i + 1, n):
            if J.linked(sets[i], sets[j]):
                assert (i, j) in got and (j, i) in got and (i, j) in leaf
                order = lambda s: J.prefix(s, J.is_frequent(s, np.sort(base[:50])))  # noqa: E731  any one order
                assert set(order(sets[i])) & set(order(sets[j]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 100), (100, 150), (300, 300)] + [(500, 500 + k) for k in range(1, 50)]
    d = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in connected_components(d).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in (100, 150, 200)} | {500 + k: 500 for k in range(50)}
    assert got == want
    assert connected_components(d.limit(0)).collect() == []


def test_all_links_and_their_number(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = {}
    for family, size, swaps in ((0, 90, 4), (1, 40, 2), (2, 3, 0)):
        base = [word() for _ in range(100)]
        for k in range(size):
            w = list(base)
            for _ in range(rng.randint(0, swaps)):
                w[rng.randrange(100)] = word()
            texts[family * 1000 + k] = " ".join(w)
    texts |= {8000: None, 8001: "", 8002: "a b"}
    sets = {i: shingles(t) for i, t in texts.items()}
    link = lambda i, j: 100 * (both := len(sets[i] & sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - both) and both > 0
    rep = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets if sets[i]}
    ids = sorted(set(rep.values()))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    links, counts = J.shingle_links(docs)
    got = [(r.a, r.b) for r in links.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for x, i in enumerate(ids) for j in ids[x + 1 :] if link(i, j)}
    assert {r.doc_id: r.n_links for r in counts.collect()} == {i: sum(link(i, j) for j in texts if j != i) for i in texts}

import binascii
import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import ngram_lm as L
from quarry.llm.elias_fano import EliasFano, open_arrays, pack_arrays
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=80), st.integers(1, 2**40))
def test_elias_fano(values, stretch):
    values = sorted(v * stretch for v in values)
    u = 5001 * stretch
    ef = EliasFano.build(np.array(values, np.uint64), u)
    ef = EliasFano.of(open_arrays(np.frombuffer(pack_arrays(ef.parts("x") | {"y": np.arange(3)}), np.uint8)), "x")
    assert ef.access(np.arange(len(values))).tolist() == values
    ask = sorted({x for v in values for x in (v - 1, v, v + 1) if 0 <= x < u} | {0, u - 1})
    i, hit = ef.successor(np.array(ask, np.uint64))
    assert i.tolist() == [sum(v < a for v in values) for a in ask]
    assert hit.tolist() == [a in values for a in ask]


def test_elias_fano_large():
    rng = np.random.default_rng(1)
    v = np.unique(rng.integers(0, 2**63, 200_000, dtype=np.uint64) * np.uint64(2))
    ef = EliasFano.build(v, 2**64)
    i, hit = ef.successor(v)
    assert hit.all() and (i == np.arange(len(v))).all()
    i, hit = ef.successor(v + np.uint64(1))
    assert not hit.any() and (i == np.arange(len(v)) + 1).all()
    bits = 8 * sum(x.nbytes for x in ef.parts("x").values()) / len(v)
    assert bits < 64 - math.log2(len(v)) + 5


def toks(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")] + [L.END.decode()]


class Brute:
    def __init__(self, texts):
        self.c, self.b = Counter(), Counter()
        for t in texts:
            s = toks(t)
            self.c.update(s)
            self.b.update(zip([s[-1], *s], s))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.kept = {k: n for k, n in self.b.items() if n >= L.MIN_COUNT}
        mass = Counter()
        for (h, _), n in self.kept.items():
            mass[h] += (n - L.DISCOUNT) / self.c[h]
        self.lam = {h: 1 - m for h, m in mass.items()}

    def p1(self, w):
        return (self.c[w] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def p(self, h, w):
        return ((self.kept[h, w] - L.DISCOUNT) / self.c[h] if (h, w) in self.kept else 0) + self.lam.get(h, 1) * self.p1(w)


def check(rows, texts, b, held):
    for r in rows:
        s = toks(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(s), sum(b.c[w] > 0 for w in s), b.n)
        assert r.held_out == held(r.doc_id)
        assert math.isclose(r.base_score, sum(math.log10(b.p1(w)) for w in s), rel_tol=1e-9)
        want = sum(math.log10(b.p(h, w)) for h, w in zip([s[-1], *s], s))
        assert abs(r.score - want) <= len(s) * L.STEP / 2 + 1e-6


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = lambda i: binascii.crc32(str(i).encode()) % 5 == 1
    b = Brute(t for i, t in texts.items() if not held(i))
    rows = L.op7_elias_fano_lm(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    check(rows, texts, b, held)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_probabilities_sum_to_one():
    b = Brute(["a b a b c", "a b", "c a a"])
    for h in [*b.c, "new"]:
        assert math.isclose(sum(b.p(h, w) for w in b.c) + b.lam.get(h, 1) * 0.5 / (b.n + 0.5 * (b.v + 1)), 1)


def test_hot_context_is_dealt_over_shards(spark):
    texts = {i: " ".join(f"the w{(i * 7 + k) % 40}" for k in range(60)) for i in range(60)}
    texts |= {100: None, 101: "", 102: "New words only", 103: "the\x0bTHE\x1c", 104: "x" * 100_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("score", F.lit("x"))
    m = L.train(docs, shards=5)
    assert m.hot and len(m.hot) < 4 * 5
    check(L.score(docs, m, F.lit(False)).collect(), texts, Brute(texts.values()), lambda i: False)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    m = L.train(docs.limit(0), shards=3)
    r = L.score(docs, m, F.lit(True)).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.score == pytest.approx(r.base_score)
    assert L.score(docs.limit(0), m, F.lit(True)).collect() == []


def test_pairs_seen_once_are_kept(spark):
    texts = {1: "a b c a d", 2: "b e", 3: "d c b"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    m = L.train(docs, shards=3)
    b = Brute(texts.values())
    b.kept = dict(b.b)  # whatever MIN_COUNT says
    b.lam = {h: 1 - sum((n - L.DISCOUNT) / b.c[h] for (x, _), n in b.kept.items() if x == h) for h in b.c}
    check(L.score(docs, m, F.lit(False)).collect(), texts, b, lambda i: False)
    reader = L.Reader(m)
    words = sorted(b.c)
    ids, counts, _ = reader.words(L.hash_words([w.encode() for w in words]))
    for (h, w), n in b.kept.items():
        i, j = words.index(h), words.index(w)
        alpha = reader.pairs(ids[[i]], ids[[j]], counts[[i]])[0]
        assert abs(math.log10(alpha) - math.log10((n - L.DISCOUNT) / b.c[h])) <= L.STEP / 2 + 1e-9


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=60), st.integers(1, 2**30), st.data())
def test_successor_in_a_range(values, stretch, data):
    values = sorted(v * stretch for v in values)
    ef = EliasFano.build(np.array(values, np.uint64), 301 * stretch)
    first = data.draw(st.integers(0, len(values)))
    stop = data.draw(st.integers(first, len(values)))
    for v in {*values, 0, 300 * stretch, values[0] + 1}:
        i, hit = ef.successor(np.array([v], np.uint64), np.array([first]), np.array([stop]))
        assert i[0] == first + sum(x < v for x in values[first:stop]) and hit[0] == (v in values[first:stop])


def test_lookup_walks_the_pointers(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "b a")], "doc_id long, text string")
    m = L.train(docs, shards=1)
    reader = L.Reader(m)
    ids, counts, _ = reader.words(L.hash_words([b"a", b"b"]))
    assert reader.pairs(ids[:1], ids[1:], counts[:1])[0] > 0
    a = reader.arrays(m.pairs[0])
    n = EliasFano.of(a, "pointers").n
    reader.open[m.pairs[0]] = a | EliasFano.build(np.zeros(n, np.uint64), 1).parts("pointers")  # empty ranges
    assert reader.pairs(ids[:1], ids[1:], counts[:1])[0] == 0

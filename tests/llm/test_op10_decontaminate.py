import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import decontaminate as D

SF = "/root/testdata/sf0.01"


@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert D.lcs(D.place_masks(list(a)), len(a), list(b)) == best[-1][-1]


def brute_lcs_share(item, words):
    """Largest LCS share of the item with any stretch of twice its length."""
    masks, n = D.place_masks(item), len(item)
    return max((D.lcs(masks, n, words[i : i + 2 * n]) for i in range(0, max(1, len(words) - n), max(1, n // 4))), default=0) / n


def test_query_against_brute_force(spark):
    texts = {r.doc_id: D.tokens((r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: D.tokens(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {r.doc_id: set(r["items"]) for r in D.op10_latent_retrieval(spark, SF).collect()}
    assert got.keys() == texts.keys()
    want = {}
    for d, w in texts.items():
        have = set(w)
        want[d] = {i for i, x in items.items() if len(have & set(x)) >= 0.6 * len(set(x)) and brute_lcs_share(x, w) >= 0.75}
    assert sum(map(bool, want.values())) > 5
    # and every document that holds a passage as it stands, but for case and blanks
    plain = lambda t: " ".join((t or "").lower().split())
    shown = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = plain(r.text)
        want[r.doc_id] |= {i for i, t in shown.items() if t in text}
    missed = [(d, want[d] - got[d]) for d in want if want[d] - got[d]]
    assert not missed, missed
    for d in got:  # what it finds is there
        for i in got[d]:
            assert brute_lcs_share(items[i], texts[d]) >= 0.5


def test_paraphrases_and_clean_texts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    stop = ["the", "of", "and", "to", "in"]
    sentence = lambda n: [rng.choice(stop) if rng.random() < 0.4 else word() for _ in range(n)]
    items = [(i, " ".join(sentence(20 + i))) for i in range(40)]
    rows, want = [], {}
    for i, t in items:
        w = t.split()
        for k in range(0, len(w), 6):  # every sixth word is another one
            w[k] = word()
        w.insert(5, "really")
        rows.append((i, " ".join(sentence(rng.randrange(80)) + w + sentence(rng.randrange(80)))))
        want[i] = {i}
    rows += [(100 + k, " ".join(sentence(200))) for k in range(60)]
    rows += [(200, None), (201, ""), (202, " ".join(sentence(60_000) + items[7][1].upper().split() + sentence(10)))]
    want[202] = {7}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit("x"))
    bench = spark.createDataFrame(items + [(900, None), (901, "of the"), (None, "x " * 30)], "item_id long, text string")
    got = {r.doc_id: set(r["items"]) for r in D.contaminated(docs, bench).collect()}
    assert got == {i: want.get(i, set()) for i, _ in rows}


def test_answers(spark):
    """The answer is asked for where some of the passage is missing; one that stands word for word is found without it."""
    words = [f"w{i}" for i in range(20)]
    text, most = " ".join(words), " ".join(words[:16] + ["x", "y"])
    others = [(i, f"other words {i}") for i in range(5, 60)]
    docs = spark.createDataFrame([(1, text), (2, text + " paris is it"), (3, most), (4, most + " paris"), *others], "doc_id long, text string")
    bench = spark.createDataFrame([(1, text, "paris"), (2, text, None)], "item_id long, text string, answer string")
    assert {r.doc_id: r["items"] for r in D.contaminated(docs, bench).collect()} == {1: [1, 2], 2: [1, 2], 3: [2], 4: [1, 2]} | {i: [] for i, _ in others}


def test_short_and_unspaced_passages(spark):
    han = "一二三四五六七八九十百千万亿水火木金土日月星天"
    near = han[:4] + "山" + han[5:12] + han[13:]
    rows = [(1, "we know the Capital of France, Paris! it is"), (2, "the capital of Paris, France"), (3, "山川" + han + "河流"), (4, "x " + near + " y"), (5, han[::-1]), (6, "of the people"), (7, "capital of france"), (8, "paris capital"), (9, "of france paris")]
    items = [(1, "capital of france paris"), (2, han), (3, "of the"), (4, "天地")]
    for extra in ([], [(9, " ".join(f"w{i}" for i in range(30)))]):  # alone, and beside a long one
        got = {r.doc_id: r["items"] for r in D.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items + extra, "item_id long, text string")).collect()}
        assert got == {1: [1], 2: [], 3: [2], 4: [2], 5: [], 6: [], 7: [], 8: [], 9: []}


def test_short_passages_stay_inside_a_text():
    p = D.Passages([7], [[b"capital", b"of", b"france"]], [[]], {b"capital": 0, b"of": 1, b"france": 2})
    p.idf2, p.vectors, p.latent, p.tier = np.ones(4), np.zeros((3, 1), np.float32), np.zeros((1, 1), np.float32), np.array([0])
    m = D.Matcher(p, D.COSINE, D.LCS_SHARE)
    assert m.find([[b"capital", b"of"], [b"france"], [b"x", b"capital", b"of", b"france"], []]) == [{}, {}, {0: 1.0}, {}]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert [r.contaminated for r in D.contaminated(docs, bench.limit(0)).collect()] == [False]
    assert D.contaminated(docs.limit(0), bench).collect() == []


def test_svd_spans_the_leading_space(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 300))
    v = D.randomised_svd(spark, [(np.arange(300), r) for r in a], 300, 5)
    assert np.allclose(a @ v @ v.T, a, atol=1e-2)


def test_paraphrases_at_any_number_of_documents():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=9)).encode()
    common = [word() for _ in range(30)]
    items = [[rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n)] for n in range(17, 64)]
    code = {}
    for x in items:
        for w in x:
            code.setdefault(w, len(code))
    texts = []
    for x in items:
        new = [word() if k % 3 == 1 else w for k, w in enumerate(x)]  # every third word is another one
        texts.append([word() for _ in range(70)] + new + [word() for _ in range(70)])
    share = np.array([0.3 if w in common else 0.001 for w in code])
    for n in (1_000, 10_000, 1_000_000, 100_000_000, 10_000_000_000):
        for df in (share * n, np.where(share > 0.1, share * n, 1)):
            p = D.Passages(list(range(len(items))), items, [[]] * len(items), code)
            p.idf2 = np.append(np.log((n + 2) / (df + 1)), np.log((n + 2) / 2)) ** 2
            rows = [D.weights(np.array([code[w] for w in x]), p.idf2) for x in items]
            p.vectors = np.eye(len(code), dtype=np.float32)
            p.latent = np.array([(v / np.linalg.norm(v)) @ p.vectors[u] for u, v in rows], np.float32)
            p.tier = np.array([max(16, 1 << (len(x) - 1).bit_length()) for x in items])
            m = D.Matcher(p, D.COSINE, D.LCS_SHARE)
            lost = [i for i, found in enumerate(m.find(texts)) if i not in found and m.verify(i, texts[i][70 - len(items[i]) // 4 : 70 + len(items[i])])]
            assert not lost, (n, lost)

import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import filter_audit as A

DOCS = "doc_id long, text string, source string, part string, fails int"


def judge(rows):
    """Failing letters of each (doc_id, text, source)."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({c for c, bad in zip("ABCDE", [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]]) if bad})
    return out


def brute(rows, labels):
    fails = judge(rows)
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1))
    out, shapley = {}, {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(i, f) for (i, _, s), f in zip(rows, fails) if (s or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, c in enumerate(order):
                removed = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                failing = sum(c in f for _, f in mine)
                out[part, "".join(order), k + 1] = (len(left), len(removed), failing - len(removed), sum(f == {c} for _, f in mine), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed))
                shapley[part, c] = shapley.get((part, c), 0) + len(removed)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], DOCS).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("z"))
    out = A.interaction_audit(docs, marks).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out}
    assert len(found) == len(out)
    return found


def corpus(seed, n=160):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(["a", "bb", "Cc", "DD", "é", "#1", "x|y"] + [f"w{i}" for i in range(rng.choice([5, 200]))], k=rng.randint(0, 90))) for _ in range(60)] + [None, "", "A" * 40]
    ids = rng.sample(range(-50, 10_000), n)
    rows = [(i, rng.choice(texts), rng.choice(["s", "s", "t", None, "ü"])) for i in ids]
    rows += rows[:6] + [(rows[0][0], "other text", "s"), (None, texts[0], "s"), (None, texts[0], "t"), (3, " ".join(f"v{i}" for i in range(60)), "clean")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in rng.choices(ids, k=n)] + [(None, 1, 1), (ids[0], None, None), (99_999, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_against_the_definition(spark, seed):
    rows, labels = corpus(seed)
    assert got(spark, rows, labels) == brute(rows, labels)


def test_small_ranges_and_steps(spark, monkeypatch):
    monkeypatch.setattr(A, "RANGE", 4)
    monkeypatch.setattr(A, "STEP", 3)
    rows, labels = corpus(5, 90)
    rows += [(7_777_777, None, "s")] * 15  # one id over several ranges
    labels += [(7_777_777, 1, 0), (7_777_777, 0, 1)]
    assert got(spark, rows, labels) == brute(rows, labels)


def test_empty_tables(spark):
    assert got(spark, [], [(1, 1, 1)]) == {}
    rows = [(1, "a", "s"), (2, "a", "s")]
    assert got(spark, rows, []) == brute(rows, [])


def test_a_third_of_all_rows_are_copies(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}", f"s{i % 4}") for i in range(600)]
    labels = [(i, 1, i % 2) for i in range(0, 600, 5)]
    assert got(spark, rows, labels) == brute(rows, labels)


def test_galloping_merge():
    rng = random.Random(2)
    for _ in range(300):
        x = np.array(sorted(rng.choices(range(400), k=rng.randint(1, 120))), np.int64)
        lists = [np.array(sorted(rng.choices(range(rng.choice([30, 400, 5000])), k=rng.randint(0, 300))), np.int64) for _ in range(4)]
        held = A.merge(x, lists)
        assert held.tolist() == [sum((v in set(y.tolist())) << k for k, y in enumerate(lists)) for v in x.tolist()]
        y, v = lists[0], rng.randint(-1, 500)
        for side in ("left", "right"):
            at = rng.randint(0, int(np.searchsorted(y, v, side)))
            assert A.gallop(y, at, v, side) == np.searchsorted(y, v, side)

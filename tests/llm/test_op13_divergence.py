import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import divergence as D
from tests.conftest import SF


def brute(rows, min_docs=3, top=200):
    """rows of (text, lang, source); the definition, term by term."""
    langs, groups, df = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        langs[lang].update(words)
        groups[lang, source].update(words)
        df[lang].update(set(words))
    out = set()
    for (lang, source), counts in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]

        def p(c):
            n = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // n for t in kept}

        mine, whole = p(counts), p(langs[lang])
        pairs = [(sum((mine[t] - q[t]) ** 2 // q[t] for t in kept), o) for (l2, o), c2 in groups.items() if l2 == lang and o != source for q in [p(c2)]]
        found = [((mine[t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[t] > 0 and mine[t] > whole[t]]
        for part, items in (("pair", pairs), ("term", found)):
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, t, v, i + 1) for i, (v, t) in enumerate(items) if part == "pair" or i < top}
    return out


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string").withColumn("count", F.lit(1)).repartition(7)
    return [tuple(r) for r in D.divergence_audit(df, **kw).collect()]


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [rng.choice(["Alpha", "beta", "é", "ßx", "日本", "zz"]) + chr(97 + i % 26) * (i % 3) for i in range(60)]
    rows = [(" ".join(rng.choices(words, weights=[1 / (1 + i) for i in range(60)], k=rng.randint(0, 30))), rng.choice(["en", "en", "fr", None]), rng.choice(["a", "b", "c", None, "é"])) for _ in range(n)]
    return rows + [("solo", "xx", "one"), (None, "yy", "q"), ("", "yy", "r"), ("1 2 3", "en", "empty")] + rows[:5]


@pytest.mark.parametrize("seed,top", [(1, 200), (2, 3), (3, 1), (4, 7)])
def test_against_the_definition(spark, seed, top):
    rows = corpus(seed)
    out = got(spark, rows, top=top)
    assert len(out) == len(set(out)) and set(out) == brute(rows, top=top)


def test_language_without_kept_terms_has_pairs_of_value_zero(spark):
    out = got(spark, [("a", "x", "s"), ("b", "x", "t"), ("c", "x", "u")])
    assert sorted(out) == sorted(brute([("a", "x", "s"), ("b", "x", "t"), ("c", "x", "u")])) and len(out) == 6 and {r[4] for r in out} == {0}


def test_empty_table(spark, docs):
    assert D.divergence_audit(docs(["a"]).limit(0)).collect() == []


def test_small_tasks_blocks_and_cells(spark, monkeypatch):
    for name, v in (("HELD", 5), ("BLOCK", 3), ("CELLS", 7), ("SALTS", 3)):
        monkeypatch.setattr(D, name, v)
    rows = corpus(9, 120)
    assert set(got(spark, rows, top=4)) == brute(rows, top=4)


@pytest.mark.parametrize("k", [1, 2, 5, 40])
def test_skyband_keeps_exactly_what_fewer_than_k_dominate(k):
    rng = random.Random(k)
    items = list({(rng.randint(1, 12), rng.randint(1, 15), t) for t in {f"t{rng.randint(0, 400)}" for _ in range(250)}})
    items = list({t: (g, lc, t) for g, lc, t in items}.values())
    items.sort(key=lambda x: (-x[0], x[1], x[2]))
    keep = D.skyband_rows([lc for _, lc, _ in items], [t for *_, t in items], k)
    kept = {t for (_, _, t), stays in zip(items, keep) if stays}
    want = {t for g, lc, t in items if sum(g2 >= g and l2 <= lc and t2 < t for g2, l2, t2 in items) < k}
    assert kept == want


def test_shares_and_sums_are_exact_at_large_counts():
    rng = random.Random(5)
    totals = np.array([8_999_999_999_999_999, 10**12 + 7, 3], np.int64)
    counts = np.array([[rng.randint(1, int(t)) for t in totals] for _ in range(50)], np.int64)
    assert D._shares(counts, totals).tolist() == [[1 + 10**9 * int(c) // int(t) for c, t in zip(row, totals)] for row in counts]


def test_plan_of_the_term_part_has_no_row_per_pair(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = D.divergence_audit(docs)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import piece_codec as P
from quarry.llm.token_counts import SPACE, default_model
from tests.conftest import SF

EDGE = [None, "", " ", "  ", "   ", "a", " a", "a ", "a  ", "  a  b ", "a\nb", "\n", "\t x", "▁", "▁▁x", "a▁", "é é ﬁ", "<s> x </s> <unk> <0x0A>", "日本語 text", "😀" * 5, "x" * 50_000, "a" + " " * 5000 + "b", "\x00 \x00", "a" + " " * 40, "ab" * 3000]


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


@pytest.fixture(scope="module")
def codec():
    return P.PieceCodec(default_model())


def test_every_piece_and_pairs_of_pieces(lib, codec):
    normal = [p for i, p in enumerate(codec.piece) if i in set(codec.id.values())]
    rng = random.Random(7)
    texts = ["\n" + p.replace(SPACE, " ") for p in normal]
    texts += ["\n" + "".join(rng.choices(normal, k=rng.randint(2, 6))).replace(SPACE, " ") for _ in range(60_000)]
    texts += [" " * n for n in range(200)] + ["a" * n for n in range(100)]
    want = lib.encode(texts, num_threads=1)
    for t, ids in zip(texts, want):
        assert codec.encode(t) == ids, repr(t)
        assert codec.decode(ids) == lib.decode(ids)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeintshrod  lm▁\nAB,.0127"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(lib, codec, text):
    ids = lib.encode(text)
    assert codec.encode(text) == ids
    assert codec.decode(ids) == lib.decode(ids)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 320), st.integers(28_700, 28_720), st.integers(0, 31_999)), max_size=12))
def test_decoding_any_ids(lib, codec, ids):
    assert codec.decode(ids) == lib.decode(ids)


def test_compatible_is_what_merging_two_pieces_says(lib, codec):
    rng = random.Random(3)
    made = [codec.id[p] for p in codec.left if SPACE not in p]
    for _ in range(20_000):
        a, b = rng.choice(made), rng.choice(made)
        alone = lib.encode("\n" + codec.piece[a] + codec.piece[b])[2:]
        assert codec.compatible(a, b) == (alone == [a, b])


def digests(lib, text):
    ids = lib.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_edges(docs, lib):
    frame = docs(EDGE).withColumn("ids", F.lit("x")).withColumn("n_tokens", F.lit("y"))
    for r in P.codec_digests(frame).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(lib, EDGE[r.doc_id]), repr(EDGE[r.doc_id])


def test_documents(spark, lib):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.op12_prefix_table_codec(spark, SF).collect()}
    assert got == {i: digests(lib, t) for i, t in texts.items()}


def test_ids_and_texts_back(docs, lib):
    texts = [t for t in EDGE if t is not None]
    ids = P.encode_documents(docs(texts))
    assert [r.ids for r in ids.orderBy("doc_id").collect()] == lib.encode(texts)
    back = [r.text for r in P.decode_documents(ids).orderBy("doc_id").collect()]
    assert back == [t.replace(SPACE, " ") for t in texts]


def test_empty_and_repeated(docs):
    assert P.codec_digests(docs(["a"]).limit(0)).collect() == []
    assert P.codec_digests(docs(["a b"]).union(docs(["a b"]))).count() == 2


def test_words_are_forgotten_beyond_the_limit(docs, lib, monkeypatch):
    monkeypatch.setattr(P, "WORDS", 2)
    monkeypatch.setattr(P, "PAIRS", 3)
    w = P.WordCodec(default_model())
    for t in ["the cat sat", "on the mat", "the cat again"]:
        words = t.split(" ")
        w.learn(set(words))
        assert w.document(words) == digests(lib, t)

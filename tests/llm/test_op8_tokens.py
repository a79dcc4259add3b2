import sentencepiece
from pyspark.sql import functions as F

from quarry.llm import token_counts as T
from tests.conftest import SF


def model():
    return sentencepiece.SentencePieceProcessor(model_file=T.default_model())


EDGE = [None, "", " ", "  ", "   ", "a", " a", "a ", "a  ", "  a  b ", "a\nb", "\n", "\t x", "▁", "▁▁x", "a▁", "é é ﬁ", "<s> x </s> <unk> <0x0A>", "日本語 text", "😀" * 5, "x" * 50_000, "a" + " " * 5000 + "b", "\x00 \x00", "a" + " " * 40]


def test_edges_against_library(docs):
    m = model()
    rows = T.token_counts(docs(EDGE).withColumn("n_tokens", F.lit("x"))).orderBy("doc_id").collect()
    for r, t in zip(rows, EDGE):
        assert r.n_tokens == len(m.encode(t or "")), repr(t)
        assert r.n_bytes == len((t or "").encode()) and r.over_limit == (r.n_tokens > 4096)


def test_documents_against_library(spark):
    m = model()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in T.op8_pretoken_counts(spark, SF).collect()}
    assert got == {i: len(m.encode(t)) for i, t in texts.items()}


def test_empty_and_repeated(docs):
    assert T.token_counts(docs(["a"]).limit(0)).collect() == []
    assert T.token_counts(docs(["a b"]).union(docs(["a b"]))).count() == 2

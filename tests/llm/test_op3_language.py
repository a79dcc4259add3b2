import binascii

from pyspark.sql import functions as F

from quarry.llm import language_cnn as L

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r for r in docs.collect()}
    rows = L.op3_byte_cnn(spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if binascii.crc32(str(i).encode()) % 5 == 0}
    scored = [r for r in held if truth[r.doc_id].lang and r.lang_pred != "und"]
    right = sum(r.lang_pred == truth[r.doc_id].lang for r in scored)
    assert right / len(scored) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_cases(spark, docs):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit_languages(base)
    long = base.filter("lang = 'fr' AND n_chars > 500").first().text
    texts = [None, "", "123 !! 45", "²", "é", long, long * 400, " " * 1000 + "the", "the \x00 and of that with"]
    d = docs(texts).withColumn("score", F.lit("x")).withColumn("held_out", F.lit(1))
    rows = L.predict_languages(d.union(d.limit(0)), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows[:4]] == ["und"] * 4 and all(r.score == 0 for r in rows[:4])
    assert all(r.lang_pred in model.langs for r in rows[4:])
    assert rows[5].lang_pred == rows[6].lang_pred == "fr"
    assert rows[6].n_windows == -(-(len((long * 400).lower().encode()) - 3) // L.STRIDE)


def test_windows_cover_every_byte():
    texts = ["abcdefgh" * k for k in (0, 1, 31, 32, 33, 100)]
    x, of, n = L.windows(texts)
    for i, t in enumerate(texts):
        w = x[of == i]
        joined = b"".join(r.tobytes()[: L.STRIDE] for r in w[:-1]) + w[-1].tobytes()
        assert joined.rstrip(b"\0") == t.encode()


def test_nothing_to_learn(docs):
    d = docs(["the"]).withColumn("lang", F.lit(None).cast("string"))
    assert L.fit_languages(d) is None
    assert [(r.lang_pred, r.score) for r in L.predict_languages(d, None).collect()] == [("und", 0.0)]
    assert L.predict_languages(d.limit(0), None).collect() == []

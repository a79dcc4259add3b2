"""Literal-row tests for the semantics that are easy to get wrong."""

from pyspark.sql import functions as F

from quarry.functions import text as TX
from quarry.operators import corpus as C
from quarry.operators import findings as FD
from quarry.operators import rules as RU
from quarry.operators.helpers import global_rank, ordered_scan


def test_first_wins_dedup_and_before_language_filter(spark):
    df = spark.createDataFrame(
        [(3, "a  b", "c", 1), (1, "a b ", "cpp", 0), (2, "x", "c", 0)], "ordinal long, code string, language string, label int")
    d = C.dedup_first(C.content_hash(df))
    kept = {r.ordinal for r in d.collect()}
    assert kept == {1, 2}  # cpp first copy removes the later c copy
    assert {r.ordinal for r in C.keep_languages(d, ["c"]).collect()} == {2}


def test_comment_stripper_no_escapes(spark):
    rows = [("a /* x */ b // y\nc",), ('s = "// not a comment"; // yes',), ("c = '\"'; /* open",)]
    out = [r[0] for r in spark.createDataFrame(rows, "code string").select(TX.strip_comments("code")).collect()]
    assert out == ["a  b \nc", 's = "// not a comment"; ', "c = '\"'; "]


def test_token_window_counts(spark):
    lens = [0, 1, 510, 511, 766, 767, 1022]
    df = spark.createDataFrame([(n, list(range(n))) for n in lens], "n int, tokens array<int>")
    w = C.token_windows(df, "tokens", 510, 256).groupBy("n").agg(
        F.count(F.lit(1)).alias("k"), F.max(F.size("chunk")).alias("mx"))
    got = {r.n: (r.k, r.mx) for r in w.collect()}
    assert got == {0: (1, 0), 1: (1, 1), 510: (1, 510), 511: (2, 510), 766: (2, 510), 767: (3, 510), 1022: (3, 510)}


def test_cve_first_match_truncates(spark):
    df = spark.createDataFrame([("fix CVE-2018-123456 and CVE-2019-0001",), ("none",)], "m string")
    assert [r[0] for r in df.select(TX.first_cve("m")).collect()] == ["CVE-2018-12345", None]


def test_merge_findings_rules(spark):
    rows = [
        (1, "u", 10, "CWE-1", "a", 0.85, "m1", "HIGH"),
        (2, "u", 10, "CWE-1", "b", 0.85, "m2", "HIGH"),   # tie: first wins
        (3, "u", 10, "CWE-1", "a", 0.50, "m3", "LOW"),
        (4, "u", 20, "CWE-2", "c", 0.98, "m4", "HIGH"),
        (5, "u", 20, "CWE-2", "d", 0.97, "m5", "HIGH"),   # cap at 1.0
        (6, "u", 30, None, "c", 0.5, "m6", "LOW"),        # null CWE passes through
        (7, "u", 40, "CWE-3", "a", 0.7, "m7", "MEDIUM"),  # single: unchanged
    ]
    f = spark.createDataFrame(rows, "finding_id long, uid string, line long, cwe_id string, tool string, confidence double, "
                                    "message string, severity string")
    f = f.withColumn("rule_id", F.lit("r")).withColumn("file_path", F.lit("f")).withColumn("col", F.lit(1))
    m = {r.line: r for r in FD.merge_findings(f).collect()}
    assert m[10].finding_id == 1 and m[10].tool == "a+b" and m[10].message == "[a, b] m1"
    assert abs(m[10].confidence - 0.90) < 1e-12 and m[10].n_merged == 3
    assert m[20].confidence == 1.0 and m[20].tool == "c+d"
    assert m[30].cwe_id is None and m[30].tool == "c"
    assert m[40].confidence == 0.7 and m[40].message == "m7"


def test_map_findings_cases(spark):
    units = spark.createDataFrame(
        [("A::f::10", "A", 10, 20), ("A::g::30", "A", 30, 40), ("A::h::50", "A", 50, 52)],
        "uid string, file_path string, start_line long, end_line long")
    fs = spark.createDataFrame(
        [(1, "A", 15), (2, "A", 25), (3, "A", 5), (4, "A", 90), (5, "A", 20), (6, "B", 3), (7, "A", 45)],
        "finding_id long, file_path string, line long")
    got = {r.finding_id: (r.uid, r.how) for r in FD.map_findings(fs, units, bucket=4).collect()}
    assert got[1] == ("A::f::10", "contained")
    assert got[2] == ("A::g::30", "nearest")       # |10-25|=15 vs |30-25|=5
    assert got[3] == ("A::f::10", "nearest")       # before the first
    assert got[4] == ("A::h::50", "nearest")       # after the last
    assert got[5] == ("A::f::10", "contained")     # closed interval
    assert 6 not in got                            # file without units
    assert got[7] == ("A::h::50", "nearest")       # gap: |30-45|=15 vs |50-45|=5


def test_equidistant_goes_to_earlier_start(spark):
    units = spark.createDataFrame([("A::a::10", "A", 10, 11), ("A::b::20", "A", 20, 21)],
                                  "uid string, file_path string, start_line long, end_line long")
    fs = spark.createDataFrame([(1, "A", 15)], "finding_id long, file_path string, line long")
    assert FD.map_findings(fs, units).collect()[0].uid == "A::a::10"


def test_safe_pattern_demotes(spark):
    df = spark.createDataFrame([("u", "f", 1, "void f(){\n strcpy(a,b);\n strncpy(a,b,1);\n}")],
                               "uid string, file_path string, start_line long, code string")
    hits = RU.scan_rules(df).filter(F.col("cwe_id") == "CWE-120").collect()
    assert len(hits) == 1 and hits[0].severity == "LOW" and hits[0].confidence == 0.57 and hits[0].line == 2
    assert hits[0].highlighted_code == "strcpy(a,b);"


def test_lookaround_rule_runs_in_java(spark):
    df = spark.createDataFrame([("u", "f", 1, "void f(char *p){\n free(p);\n p->x = 1;\n}")],
                               "uid string, file_path string, start_line long, code string")
    hits = RU.scan_rules(df).filter(F.col("cwe_id") == "CWE-416").collect()
    assert len(hits) >= 1 and hits[0].line == 2


def test_path_labels(spark):
    rows = [("t/CWE121_x/a_bad.c",), ("t/CWE121_x/a_good.c",), ("t/CWE690_y/CWE690_x_good_goodG2B.c",), ("t/CWE1/x.h",)]
    got = [tuple(r) for r in C.with_path_labels(spark.createDataFrame(rows, "path string")).collect()]
    assert [g[2] for g in got] == [1, 0, 1, None] and got[0][1] == "CWE121"


def test_split_precedence():
    m = dict(C.split_map_rows())
    assert m["CWE690"] == "train" and m["CWE197"] == "val"


def test_ordered_scan_matches_window(spark):
    from pyspark.sql import Window as W
    df = spark.range(0, 500).select((F.col("id") % 7).alias("k"), "id", (F.col("id") % 5).alias("v"))
    got = ordered_scan(df, ["id"], "v", ["k"], "c", inclusive=False, num_partitions=6)
    ref = df.withColumn("r", F.coalesce(F.sum("v").over(W.partitionBy("k").orderBy("id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    assert got.join(ref, ["k", "id"]).filter("c != r").count() == 0
    rk = global_rank(df, ["v", "id"], num_partitions=4)
    assert sorted(r.rank for r in rk.collect()) == list(range(1, 501))

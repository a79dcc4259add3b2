"""Features, segmentation, tokenizer, validator and remaining readers."""

import json
import re
import time

import pandas as pd
from pyspark.sql import functions as F

from tests.conftest import SF

from quarry.operators import corpus as C
from quarry.operators import findings as FD
from quarry.operators import rules as RU
from quarry.plans.q_rules import C_SAMPLE
from quarry.plans.registry import queries
from quarry.sources import files as FS

C_FILE = """int add(int a, int b) {
    return a + b;
}

static void loop(int n)
{
    for (int i = 0; i < n; i++) {
        if (i % 2) { puts("}"); }
    }
}
/* { not a brace */
int last(void) { return 1; }"""


def _units(spark, code):
    return spark.createDataFrame([("u", "f.c", 1, code)], "uid string, file_path string, start_line long, code string")


def test_cognitive_complexity(spark):
    code = "void f(){ if (a) { for (;;) { while (b) { x(); } } } else { y(); } }"
    got = RU.cognitive_complexity(_units(spark, code)).collect()[0].cognitive_complexity
    # if: 1+0, for: 1+1, while: 1+2  (else has no keyword weight here)
    assert got == 6


def test_complexity_features(spark):
    r = RU.complexity_features(_units(spark, "x = a[i]; if (i < n) y = b[j];")).collect()[0]
    assert (r.accesses, r.checks, r.bounds_score) == (2, 1, 1.0)
    assert r.halstead_difficulty > 0


def test_complexity_features_can_be_written(spark, tmp_path):
    df = queries()["complexity_features"](spark, SF)
    df.write.parquet(str(tmp_path / "out"))
    assert spark.conf.get("spark.sql.caseSensitive") == "false"
    back = df.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.columns == df.columns and {"n1", "N1", "n2", "N2"} < set(back.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_rules_run_only_on_units_with_their_literals(spark):
    assert RU.needed_literals(r"(\w+)\s*=\s*\b(malloc|calloc)\s*\([^)]*\)(?:x|y)?(?!z)") == [
        frozenset(["="]), frozenset(["malloc", "calloc"]), frozenset(["("]), frozenset([")"])]
    assert RU.needed_literals(r"a|\w") == RU.needed_literals("(?:abc)*[ab]") == []
    assert RU.needed_literals("Ab|(?:c{2})") == [frozenset(["ab", "c"])]
    # one long word: \w+ fails at every place of it, which is square in its length
    word = "a" * 400_000
    began = time.time()
    got = RU.scan_rules(_units(spark, word + "\nSTRCPY (a, b);")).collect()
    assert [(r.pattern_id, r.line) for r in got] == [("CWE-120#0", 2)] and time.time() - began < 30


def test_literals_lose_no_match():
    texts = [c for *_, c in C_SAMPLE] + [c.upper() for *_, c in C_SAMPLE] + [
        "p = malloc(n * 4); p[0] = 1;", "free(p); x = p->y; *p; free ( p )", "f = fopen(a); fread (b", "stat(x); open (x)", "int n; n+1",
        " read (fd)", "memcpy(a, b, n)", "x[ argv", "strdup(a)", "../a", "open(getenv", "printf(s)", "fprintf(f, s)", "popen (", "atof(", "gets("]
    for *_, p, _, safe in RU.live_c_rules():
        for pattern in (p, *safe):
            found = [x for x in texts if re.search(pattern, x, re.I | re.S)]
            assert all(any(w in x.lower() for w in clause) for x in found for clause in RU.needed_literals(pattern))


def test_segment_units(spark):
    files = spark.createDataFrame([("f.c", C_FILE)], "path string, content string")
    got = sorted((r.function_name, r.start_line, r.end_line) for r in RU.segment_units(files).collect())
    # a brace on its own line starts the unit on that line; literal '}' and comments are ignored
    assert got == [("add", 1, 3), ("last", 12, 12), ("loop", 5, 10)]


def _functions(code):
    return [(n, a, b) for n, a, b, _ in RU.find_functions(code)]


def test_segmentation_of_code_as_found():
    assert _functions("}\nint a(){}\nint b(){ if (x) { } }") == [("a", 2, 2), ("b", 3, 3)]
    assert _functions("int a(){ /* { \n } if { */ return 1; }\nint b(){}") == [("a", 1, 2), ("b", 3, 3)]
    assert _functions('extern "C" {\nint a(void) { return 1; }\nint b() {}\n}\nint c(){}') == [("a", 2, 2), ("b", 3, 3), ("c", 5, 5)]
    assert _functions("#ifdef X\nint a(int x) {\n#else\nint a(long x) {\n#endif\n return 1;\n}\nint b() {}\n") == [("a", 2, 7), ("b", 8, 8)]
    assert _functions("class Foo {\npublic:\n int bar(int x) { return x * 2; }\n};\nstruct S { int a; };\nint t[] = {1, 2};") == [("bar", 3, 3)]
    assert _functions("void foo() { }\nint bar(int x) { return x; }\nchar *baz(char *s) { return s; }\n") == [("foo", 1, 1), ("bar", 2, 2), ("baz", 3, 3)]
    assert _functions("") == _functions("#include <stdio.h>\nint x = 5;\nfloat PI = 3.14;") == []


def test_large_file_keeps_its_function(spark):
    body = "int big(void) {\n" + "  x = x + 1;\n" * 130_000 + "}\n"
    assert len(body) > 1_500_000
    files = spark.createDataFrame([("f.c", body), ("g.c", None)], "path string, content string")
    assert [(r.function_name, r.end_line, len(r.code)) for r in RU.segment_units(files).collect()] == [("big", 130_002, len(body) - 1)]


def test_rule_scan_grows_with_the_text(spark):
    import time
    took = []
    for n in (2_000, 2_000, 8_000):
        t = time.time()
        assert RU.scan_rules(_units(spark, "strcpy(a, b);\n" * n)).filter("cwe_id = 'CWE-120'").count() == n
        took.append(time.time() - t)
    assert took[2] < 6 * took[1] + 3


def test_blank_code_and_metrics(spark):
    rows = [("a", "\n\t"), ("b", "\u00a0\u2003"), ("c", "x\r\n\r\nyz"), ("d", None)]
    df = spark.createDataFrame(rows, "id string, code string")
    assert [r.id for r in C.drop_empty(df).collect()] == ["c"]
    m = C.text_metrics(df.filter("id = 'c'")).first()
    # lines "x\r", "\r", "yz": 5 characters without line ends
    assert (m.total_lines, m.non_empty_lines, m.n_chars, m.avg_line_length) == (3, 2, 7, 5 / 3)


def test_labelled_records(spark):
    rows = [("t/CWE12_x/a_bad.c", "void f(){}", "CWE12", 1), ("t/y.c", "x", None, 1), ("t/CWE1/z.h", "x", "CWE1", None),
            ("t/CWE1/e_bad.c", "\n", "CWE1", 1), ("t/CWE1/l_bad.c", "x" * 100_001, "CWE1", 1)]
    df = spark.createDataFrame(rows, "path string, content string, category string, label int")
    assert [tuple(r) for r in C.normalize_labelled(df).collect()] == [("void f(){}", 1, "suite", "CWE12", "a_bad.c")]
    assert {r.path: r.reason for r in C.skipped_labelled(df).collect()} == {
        "t/y.c": "no_category", "t/CWE1/z.h": "no_label", "t/CWE1/e_bad.c": "empty", "t/CWE1/l_bad.c": "too_long"}


def test_report_path_prefers_the_absolute_path(spark):
    files = spark.createDataFrame([("a.c", "/co/a.c"), ("src/a.c", "/co/src/a.c")], "rel_path string, abs_path string")
    report = spark.createDataFrame([(1, "/co/src/a.c"), (2, "elsewhere/a.c"), (3, "b.c")], "id int, path string")
    got = {r.id: r.rel_path for r in FD.resolve_report_paths(report, files, abs_col="abs_path").collect()}
    assert got == {1: "src/a.c", 2: "a.c"}


def test_summary_counts_units_per_type(spark):
    units = spark.createDataFrame([("u", "f", "a.c", 1, "x" * 600), ("v", "g", "a.c", 9, "y")],
                                  "uid string, function_name string, file_path string, start_line long, code string")
    f = spark.createDataFrame([(1, "u", 2, "CWE-120", "t", 0.9, "m", "HIGH"), (2, "u", 3, "CWE-120", "t", 0.9, "m", "HIGH")],
                              "finding_id long, uid string, line long, cwe_id string, tool string, confidence double, message string, severity string")
    r = FD.static_report(units, f)
    got = {(x.kind, x.key): x.value for x in FD.static_summary(r).collect()}
    name = "CWE-120: Buffer Copy without Checking Size of Input (Classic Buffer Overflow)"
    assert got == {("total", "functions"): 2, ("total", "vulnerable"): 1, ("total", "safe"): 1, ("total", "findings"): 2, ("tool", "t"): 2, ("cwe", name): 1}
    rows = {x.uid: x for x in r.collect()}
    assert len(rows["u"].static_findings) == 2 and rows["u"].code_snippet.endswith("...") and rows["v"].static_findings == []


def test_auc_of_many_rows_does_not_overflow(spark):
    from quarry.operators import evaluate as EV
    big = 4_000_000_000
    lv = spark.createDataFrame([(0.1, 0, big), (0.9, big, 0)], "score double, pos long, neg long")
    scored = lv.selectExpr("score", "pos", "neg")
    EV_levels = EV.score_levels
    try:
        EV.score_levels = lambda *a: scored
        assert EV.roc_auc(scored).first().roc_auc == 1.0
    finally:
        EV.score_levels = EV_levels


def test_pluggable_tokenizer(spark):
    df = spark.createDataFrame([("a  b\tc",)], "code string")

    def ws(s: pd.Series) -> pd.Series:
        return s.str.split()

    assert C.tokenize(df, fn=ws).collect()[0].tokens == ["a", "b", "c"]
    assert C.tokenize(df).collect()[0].tokens == ["a", "b", "c"]


def test_validator_missing_vs_null(spark):
    lines = [
        '{"id":"1","dataset":"d","language":"c","code":"x","label_binary":1,"label_cwe":null,"label_cve":null}',
        '{"id":"2","dataset":"d","language":"c","code":"x","label_binary":1,"label_cwe":null}',
        '{"id":"3","dataset":"d","language":"c","code":"  ","label_binary":1,"label_cwe":null,"label_cve":null}',
        '{"id":"4","dataset":"d","language":"rust","code":"x","label_binary":true,"label_cwe":"CWE-1","label_cve":null}',
        '{"id":"5","dataset":"d","language":"c","code":"x","label_binary":"1","label_cwe":null,"label_cve":null}',
        '{"id":"6","dataset":"d","language":"c","code":"x","label_binary":2,"label_cwe":null,"label_cve":null}',
        '{"id":"7", broken',
    ]
    v = C.validate_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {r.value[:12]: (r.error, r.warning, r.label) for r in v.collect()}
    errs = [got[k][0] for k in sorted(got)]
    assert errs == [None, "missing_field_label_cve", "empty_code", None, "invalid_label_1", "invalid_label_2",
                    "json_decode_error"]
    assert got[sorted(got)[3]][1] == "unknown_language_rust" and got[sorted(got)[3]][2] == 1
    verdict = C.corpus_verdict(v, ["dataset"]).collect()
    assert [r.dataset for r in verdict] == ["d", None]


def test_json_array_and_predictions(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps([{"func": "int a;", "target": 1, "commit_id": "c1"}, {"func": " ", "target": None}]))
    raw = FS.read_raw_json_array(spark, str(p), "func string, target int, commit_id string")
    assert raw.count() == 2
    q = tmp_path / "p.json"
    q.write_text(json.dumps({"predictions": [1, 0], "probabilities": [0.9, 0.2], "labels": [1, 1]}))
    rows = FS.read_predictions(spark, str(q)).collect()
    assert [(r.prediction, r.score, r.label) for r in rows] == [(1, 0.9, 1), (0, 0.2, 1)]


def test_raw_values_on_and_over_lines(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"func":"a"} {"func":"b"}\n{"func":\n"c"}\n3 "x"\n{broken\n{"func":"d"}')
    got = FS.read_raw_json_values(spark, str(tmp_path / "v.json"), "func string")
    assert [r.func for r in got.collect()] == ["a", "b", "c", "d"] and got.columns == ["func"]


def test_raw_values_skip_non_objects(spark, tmp_path):
    p = tmp_path / "v.jsonl"
    p.write_text('{"func": "a", "target": 1}\n[1, 2]\n"text"\n{"func": "b", "target": 0}\n')
    df = FS.read_raw_json_values(spark, str(p), "func string, target int")
    assert sorted(r.func for r in df.collect()) == ["a", "b"]


def test_labelled_files(spark, tmp_path):
    d = tmp_path / "testcases" / "CWE121_x" / "s01"
    d.mkdir(parents=True)
    (d / "CWE121_x__a_bad.c").write_text("void bad(){}")
    (d / "CWE121_x__a_good.c").write_text("void good(){}")
    rows = sorted((r.path.split("/")[-1], r.category, r.label) for r in FS.read_labelled_files(spark, str(tmp_path)).collect())
    assert rows == [("CWE121_x__a_bad.c", "CWE121", 1), ("CWE121_x__a_good.c", "CWE121", 0)]


def test_verdicts_state_percentages(spark):
    rows = [(None, 0)] * 1 + [(None, 1)] * 69 + [("bad", None)] * 10
    v = spark.createDataFrame([(e, x, "c", True, True, "d") for e, x in rows], "error string, label int, language string, cwe_empty boolean, cve_empty boolean, dataset string")
    got = C.corpus_verdict(v, ["dataset"]).first()
    assert got.issues == "12.5% of records are invalid; Class imbalance: Safe is only 1.4%" and not got.is_safe


def test_lines_of_matches_are_the_text_s_own(spark):
    """A private-use character of the text, the scan's own mark, stays as it is."""
    code = "int x;\nstrcpy(a, \"\ue000b\ue001\"); strcpy(c, d);\n"
    row = spark.createDataFrame([(code,)], "code string").select(RU.match_lines(F.col("code"), r"strcpy\s*\(").alias("m")).first()
    assert [(x.off, x.text, x.n) for x in row.m] == [(1, "strcpy(a, \"\ue000b\ue001\"); strcpy(c, d);", 2)]

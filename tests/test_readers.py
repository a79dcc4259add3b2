"""Report readers, archives and source trees on small files written per test."""

import io
import json
import zipfile

from quarry.sources import files as FS

XML = """<?xml version="1.0"?>
<results><errors>
<error id="nullPointer" severity="style" msg="short" verbose="Null pointer deref" cwe="476">
  <location file="a.c" line="12" column="5"/><location file="a.c" line="30" column="1"/></error>
<error id="unusedVariable" severity="style" msg="unused" cwe="563"><location file="a.c" line="3" column="2"/></error>
<error id="missingInclude" severity="information" msg="x"><location file="a.c" line="1" column="1"/></error>
<error id="bufferAccessOutOfBounds" severity="error" msg="overflow" cwe="788"><location file="a.c" line="0" column="1"/></error>
<error id="arrayIndexOutOfBounds" severity="error" msg="index"><location file="a.c" line="7" column="3"/></error>
</errors></results>"""

CSV = (
    'File,Line,Column,DefaultLevel,Level,Category,Name,Warning,Suggestion,Note,CWEs,Context,Fingerprint,ToolVersion,RuleId,HelpUri\n'
    'a.c,10,5,4,4,buffer,strcpy,"Does not check for buffer overflows (CWE-120)",,,CWE-120,"  strcpy(a, b);",x,1,FF1,'
    'https://cwe.mitre.org/data/definitions/120.html\n'
    'a.c,11,1,1,1,misc,open,"",,,,"open(\n f)",y,1,FF2,\n'
    'a.c,abc,1,1,1,misc,bad,"x",,,,"",z,1,FF3,\n'
)
CSV_URL_ONLY = 'Line,Column,Level,Category,Name,Warning,Note,CWEs,Context,URL\n5,2,3,race,access,"check then use",,,"access(p)",https://cwe.mitre.org/data/definitions/362.html\n'

JSON_REPORT = {"results": [
    {"path": "/tmp/x/src/a.c", "check_id": "c-format-string", "start": {"line": 4, "col": 2},
     "extra": {"severity": "ERROR", "message": "fmt", "lines": "  printf(s);", "metadata": {"cwe": ["CWE-134: Format"]}}},
    {"path": "src/b.c", "check_id": "c-dangerous-atoi", "start": {"line": 9, "col": 1},
     "extra": {"severity": "WARNING", "message": "atoi", "metadata": {"cwe": "CWE-676"}}},
    {"path": "src/c.c", "check_id": "zero", "start": {"line": 0, "col": 1}, "extra": {"severity": "INFO"}},
]}


def test_xml_report(spark, tmp_path):
    p = tmp_path / "r.xml"
    p.write_text(XML)
    rows = {r.rule_id: r for r in FS.read_findings_xml(spark, str(p)).collect()}
    assert set(rows) == {"nullPointer", "arrayIndexOutOfBounds"}
    assert rows["nullPointer"].line == 12 and rows["nullPointer"].message == "Null pointer deref"
    assert rows["nullPointer"].severity == "MEDIUM" and rows["nullPointer"].cwe_id == "CWE-476"
    assert rows["arrayIndexOutOfBounds"].severity == "HIGH" and rows["arrayIndexOutOfBounds"].cwe_id is None


def test_xml_report_without_optional_parts(spark, tmp_path):
    p = tmp_path / "r.xml"
    p.write_text('<results><errors><error id="a" severity="error" msg="m"><location file="x.c" line="2"/></error></errors></results>')
    r = FS.read_findings_xml(spark, str(p)).collect()
    assert [(x.message, x.line, x.col, x.file_path) for x in r] == [("m", 2, None, "x.c")]
    p.write_text("<results><errors></errors></results>")
    assert FS.read_findings_xml(spark, str(p)).collect() == []


def test_csv_report(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text(CSV)
    rows = sorted(FS.read_findings_csv(spark, str(p), "a.c").collect(), key=lambda r: r.line)
    assert [r.line for r in rows] == [10, 11]
    assert rows[0].cwe_id == "CWE-120" and rows[0].severity == "HIGH" and rows[0].highlighted_code == "strcpy(a, b);"
    assert rows[1].message.startswith("open: open(")
    q = tmp_path / "u.csv"
    q.write_text(CSV_URL_ONLY)
    r = FS.read_findings_csv(spark, str(q), "b.c").collect()[0]
    assert r.cwe_id == "CWE-362" and r.severity == "MEDIUM"


def test_json_report(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps(JSON_REPORT))
    strict = {r.rule_id: r for r in FS.read_findings_json(spark, str(p)).collect()}
    assert set(strict) == {"c-format-string", "c-dangerous-atoi"}
    assert strict["c-format-string"].cwe_id == "CWE-134" and strict["c-dangerous-atoi"].cwe_id is None
    loose = {r.rule_id: r for r in FS.read_findings_json(spark, str(p), strict_list=False).collect()}
    assert loose["c-dangerous-atoi"].cwe_id == "CWE-676" and loose["c-dangerous-atoi"].severity == "MEDIUM"


def test_zip_archives_skip_unsafe_members(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("src/a.c", "int main(){}")
        z.writestr("../evil.c", "x")
        z.writestr("/abs.c", "y")
        z.writestr("..\\\\x.c", "z")
    (tmp_path / "a.zip").write_bytes(buf.getvalue())
    rows = FS.read_source_archives(spark, str(tmp_path / "*.zip")).collect()
    assert [r.member for r in rows] == ["src/a.c"]


def test_source_tree_latin1_fallback(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "u.c").write_bytes("int é;".encode("utf-8"))
    (tmp_path / "d" / "l.c").write_bytes("int é;".encode("latin-1"))
    rows = {r.abs_path.split("/")[-1]: r.content for r in FS.read_source_tree(spark, str(tmp_path), "*.c").collect()}
    assert rows == {"u.c": "int é;", "l.c": "int é;"}


def test_corpus_jsonl_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([("i", "d", "c", "x", 1, None, None)],
                               "id string, dataset string, language string, code string, label_binary int, "
                               "label_cwe string, label_cve string")
    FS.write_corpus_jsonl(df, str(tmp_path / "c"))
    lines = [ln for p in (tmp_path / "c").iterdir() if p.name.startswith("part-")
             for ln in p.read_text().splitlines() if ln.strip()]
    assert len(lines) == 1
    assert set(json.loads(lines[0])) == {"id", "dataset", "language", "code", "label_binary", "label_cwe", "label_cve"}
    back = FS.read_corpus(spark, str(tmp_path / "c")).collect()[0]
    assert back.label_cwe is None and back._corrupt_record is None


def test_source_tree_rules(spark, tmp_path):
    from quarry.operators import corpus as C
    for path, text in {"a/x.C": "int a;", "a/build/y.c": "n", "a/.git/z.c": "n", "a/r.txt": "n", "b/h.hpp": "x", "b/big.c": "y" * (1 << 20) + "y"}.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    got = sorted(tuple(r) for r in FS.read_accepted_files(spark, str(tmp_path)).select("rel_path", "language", "size", "content").collect())
    assert got == [("a/x.C", "c", 6, "int a;"), ("b/h.hpp", "cpp", 1, "x")]
    skipped = C.skipped_files(FS.list_source_tree(spark, str(tmp_path))).collect()
    assert [tuple(r) for r in skipped] == [("b/big.c", "too large (1,048,577 bytes)")]

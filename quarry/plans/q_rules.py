"""Rule-scan and feature queries (J7-J10, X1-X8) over all code units.

Units = documents (as functions) + pages (one unit per page) + a small C
sample written for this repo, so both volume and real rule hits occur.
Lookaround / back-reference rules run in Java regex only: their query has
no SQL oracle; the RE2-safe subset has one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as RU
from ..sources.fixed import SEVERITY_CONFIDENCE, TEXT_RULES
from ..functions import text as TX
from ..session import case_sensitive
from . import views as V
from .registry import register

# Our own small C sample (not taken from anywhere): known weak spots per function.
C_SAMPLE = [
    ("sample/net.c", "copy_name", 3,
     'void copy_name(char *dst, const char *src) {\n    char tmp[16];\n    strcpy(tmp, src);\n'
     '    sprintf(dst, "%s!", tmp);\n}'),
    ("sample/net.c", "run_tool", 10,
     'int run_tool(const char *arg) {\n    char cmd[128];\n    snprintf(cmd, sizeof(cmd), "tool %s", arg);\n'
     '    return system(cmd);\n}'),
    ("sample/net.c", "parse_len", 17,
     'int parse_len(const char *s) {\n    int n = atoi(s);\n    char *p = malloc(n * sizeof(int));\n'
     '    p[0] = 1;\n    free(p);\n    printf(s);\n    return n;\n}'),
    ("sample/mem.c", "reuse", 1,
     'void reuse(char *q) {\n    free(q);\n    q->next = 0;\n    FILE *f = fopen(q, "r");\n    fread(buf, 1, 8, f);\n}'),
    ("sample/mem.c", "race", 9,
     'int race(const char *path) {\n    if (access(path, W_OK) == 0) {\n        int fd = open(path, O_WRONLY);\n'
     '        return fd;\n    }\n    return -1;\n}'),
    ("sample/mem.c", "walk", 18,
     'void walk(char **argv) {\n    char *line = gets(buf);\n    memcpy(dst, src, len);\n'
     '    char *x = strdup("../etc");\n    int y;\n    y++;\n}'),
]


def code_units(spark, d):
    """Documents, pages and the C sample as units.  The tables are files of one row group here,
    so this caller deals their texts out before the scans, which are far dearer than the
    exchange; the operators themselves add none.  The number of partitions is given, as the
    work per byte is too high for partitions to be put together by size."""
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    u = V.v_units(spark, d).select("uid", "file_path", "start_line", "code")
    p = V.table(spark, d, "pages").select(
        F.concat(F.lit("page::"), F.col("page_id").cast("string")).alias("uid"), F.col("url").alias("file_path"),
        F.lit(1).cast("long").alias("start_line"), F.col("html").alias("code"))
    s = spark.createDataFrame([(f"{f}::{n}::{st}", f, st, c) for f, n, st, c in C_SAMPLE],
                              "uid string, file_path string, start_line long, code string")
    return u.unionByName(p).repartition(n, "uid").unionByName(s)


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


V.SQL_VIEWS["v_code_units"] = (["v_units"], """
SELECT uid, file_path, start_line, code FROM v_units
UNION ALL SELECT 'page::' || CAST(page_id AS VARCHAR), url, CAST(1 AS BIGINT), html FROM pages
UNION ALL SELECT * FROM (VALUES """ + ", ".join(
    f"({_sql_str(f'{f}::{n}::{st}')}, {_sql_str(f)}, CAST({st} AS BIGINT), {_sql_str(c)})" for f, n, st, c in C_SAMPLE)
    + ") AS fx(uid, file_path, start_line, code)")


def _rules_sql(rules, flags="(?is)"):
    rows = []
    for cwe, name, sev, idx, p, msg, safe in rules:
        conf = SEVERITY_CONFIDENCE[sev]
        safe_sql = "[" + ", ".join(_sql_str(flags + s) for s in safe) + "]::VARCHAR[]"
        rows.append(f"({_sql_str(cwe)}, {_sql_str(name)}, {_sql_str(sev)}, {_sql_str(f'{cwe}#{idx}')}, "
                    f"{_sql_str(flags + p)}, {_sql_str(msg)}, CAST({conf!r} AS DOUBLE), CAST({round(conf * 0.6, 2)!r} AS DOUBLE), "
                    f"{safe_sql})")
    return "(VALUES " + ", ".join(rows) + ") AS r(cwe_id, cwe_name, sev, pattern_id, pat, message, conf, conf_low, safe)"


NL = "length({x}) - length(replace({x}, chr(10), ''))"


def scan_sql(rules, flags="(?is)", tool="pattern_matcher", rule_id="'regex:' || cwe_id", name_col="cwe_name"):
    return f"""
WITH m AS (SELECT u.uid, u.file_path, u.start_line, u.code, r.*,
                  len(list_filter(r.safe, lambda sp: regexp_matches(u.code, sp))) > 0 AS has_safe,
                  regexp_split_to_array(u.code, r.pat) AS segs, regexp_extract_all(u.code, r.pat, 0) AS ms
           FROM v_code_units u JOIN {_rules_sql(rules, flags)} ON regexp_matches(u.code, r.pat)),
x AS (SELECT *, unnest(generate_series(1, len(ms))) AS i FROM m),
o AS (SELECT *, CAST(coalesce(list_sum(list_transform(segs[1:i], lambda s: {NL.format(x='s')})), 0)
              + coalesce(list_sum(list_transform(ms[1:i - 1], lambda s: {NL.format(x='s')})), 0) AS BIGINT) AS off FROM x)
SELECT uid, file_path, '{tool}' AS tool, {rule_id} AS rule_id, pattern_id, cwe_id, {name_col} AS cwe_name,
       CASE WHEN has_safe THEN 'LOW' ELSE sev END AS severity, CASE WHEN has_safe THEN conf_low ELSE conf END AS confidence,
       message, start_line + off AS line,
       regexp_replace(string_split(code, chr(10))[off + 1], '^\\s+|\\s+$', '', 'g') AS highlighted_code
FROM o"""


@register("scan_rules_re2", scan_sql(RU.live_c_rules(re2_only=True)))
def scan_rules_re2(spark, d):
    """All matches of the RE2-compatible rules (20 of 26 live patterns) with line and snippet."""
    return RU.scan_rules(code_units(spark, d), RU.live_c_rules(re2_only=True))


@register("scan_rules")
def scan_rules(spark, d):
    """All 26 live patterns incl. lookaround/back-reference ones (Java regex only)."""
    return RU.scan_rules(code_units(spark, d))


@register("rule_hits_by_cwe")
def rule_hits_by_cwe(spark, d):
    """Rule-hit counts per unit pivoted by CWE (all rules)."""
    hits = RU.scan_rules(code_units(spark, d))
    cwes = sorted({r[0] for r in RU.live_c_rules()})
    return hits.groupBy("uid").pivot("cwe_id", cwes).count().na.fill(0)


_RE2_CWES = sorted({r[0] for r in RU.live_c_rules(re2_only=True)})


@register("rule_hits_by_cwe_re2", "SELECT uid, " + ", ".join(f"count(*) FILTER (cwe_id = '{c}') AS \"{c}\"" for c in _RE2_CWES)
          + f" FROM ({scan_sql(RU.live_c_rules(re2_only=True))}) h GROUP BY uid")
def rule_hits_by_cwe_re2(spark, d):
    """X9 over the RE2-compatible rules."""
    hits = RU.scan_rules(code_units(spark, d), RU.live_c_rules(re2_only=True))
    return hits.groupBy("uid").pivot("cwe_id", _RE2_CWES).count().na.fill(0)


def _detect_sql():
    parts = []
    for cwe, name, sev, text, pats, safe, mit, fix in TEXT_RULES:
        vul = " OR ".join(f"regexp_matches(code, {_sql_str('(?i)' + p)})" for p in pats)
        ok = " OR ".join(f"regexp_matches(code, {_sql_str('(?i)' + p)})" for p in safe) or "FALSE"
        parts.append(f"SELECT uid, '{cwe}' AS cwe_id, {_sql_str(name)} AS name, '{sev}' AS severity, {_sql_str(text)} AS description, {_sql_str(mit)} AS mitigation, "
                     f"{_sql_str(fix)} AS example_fix, 'high' AS confidence "
                     f"FROM v_code_units WHERE ({vul}) AND NOT ({ok})")
    return " UNION ALL ".join(parts)


@register("detect_rules", _detect_sql())
def detect_rules(spark, d):
    """Second rule base: any vulnerable pattern and no safe pattern -> one row per CWE."""
    return RU.detect_rules(code_units(spark, d))


def _keywords_sql():
    from ..sources.fixed import KEYWORD_RULES
    items = []
    for cwe, needles, name in KEYWORD_RULES:
        cond = " OR ".join(f"contains(lower(code), {_sql_str(n)})" for n in needles.split("|"))
        items.append(f"CASE WHEN {cond} THEN '{cwe}: {name}' END")
    arr = "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"
    return f"SELECT uid, CASE WHEN len({arr}) = 0 THEN 'CWE-Unknown' ELSE array_to_string({arr}, '; ') END AS cwe_types FROM v_code_units"


@register("detect_keywords", _keywords_sql())
def detect_keywords(spark, d):
    k = RU.detect_keywords(code_units(spark, d))
    return k.select("uid", F.array_join("cwe_types", "; ").alias("cwe_types"))


def _call_rules():
    from ..sources.fixed import CALL_RULE_REGEX, CALL_RULES, JSON_TOOL_SEVERITY
    return [(cwe, rid, JSON_TOOL_SEVERITY.get(level, "LOW"), 0, CALL_RULE_REGEX[rid], msg, [])
            for rid, level, cwe, msg in CALL_RULES]


@register("scan_calls", scan_sql(_call_rules(), flags="(?s)", tool="call_rules", rule_id="cwe_name",
                                 name_col="CAST(NULL AS VARCHAR)"))
def scan_calls(spark, d):
    return RU.scan_calls(code_units(spark, d))


@register("lexical_features", f"""
WITH b AS (SELECT uid, code, string_split(code, chr(10)) AS lines, regexp_extract_all(code, '[{{}}]', 0) AS br FROM v_code_units),
d AS (SELECT *, list_transform(generate_series(1, len(br)), lambda k: list_sum(list_transform(br[1:k], lambda c: CASE WHEN c = '{{' THEN 1 ELSE -1 END))) AS depths FROM b)
SELECT uid, len(lines) AS total_lines, len(list_filter(lines, lambda l: regexp_matches(l, '\\A[{TX.WS_RE2}]*\\z'))) AS blank_lines,
       round(CAST(len(list_filter(lines, lambda l: regexp_matches(l, '\\A[{TX.WS_RE2}]*\\z'))) AS DOUBLE) / CAST(len(lines) AS DOUBLE), 6) AS blank_ratio,
       round(CAST(list_sum(list_transform(lines, lambda l: length(l))) AS DOUBLE) / CAST(len(lines) AS DOUBLE), 6) AS mean_line_length,
       len(regexp_extract_all(code, '\\b(?:strcpy|strcat|sprintf|vsprintf|gets|scanf|memcpy|memmove)\\s*\\(', 0)) AS unsafe_calls,
       len(regexp_extract_all(code, '\\b(?:strncpy|strncat|snprintf|fgets|strlcpy|memcpy_s)\\s*\\(', 0)) AS safe_calls,
       len(regexp_extract_all(code, '\\b(?:if|for|while|case|catch)\\b|&&|\\|\\|', 0)) AS branches,
       len(regexp_extract_all(code, '\\b(?:if|for|while|case|catch)\\b|&&|\\|\\|', 0)) + 1 AS cyclomatic,
       CAST(greatest(coalesce(list_max(depths), 0), 0) AS INTEGER)
         AS max_brace_depth,
       round(list_aggregate(list_transform(lines, lambda l: CAST(length(l) AS DOUBLE)), 'stddev_pop'), 6) AS std_line_length,
       CASE WHEN len(br) = 0 THEN 0.0 ELSE round(sqrt(CAST(CAST(list_sum(list_transform(depths, lambda k: k * k)) AS BIGINT) * len(br)
         - CAST(list_sum(depths) AS BIGINT) * CAST(list_sum(depths) AS BIGINT) AS DOUBLE)) / len(br), 6) END AS std_brace_depth,
       len(regexp_extract_all(code, '\\b(?:malloc|calloc|realloc|strdup)\\s*\\(', 0)) AS allocations,
       len(regexp_extract_all(code, '\\bfree\\s*\\(', 0)) AS frees,
       len(regexp_extract_all(code, '\\w\\s*\\*\\s*\\w', 0)) AS pointer_ops
FROM d""")
def lexical_features(spark, d):
    """Line stats, unsafe/safe calls, branches, cyclomatic, brace depth, allocations."""
    return RU.lexical_features(code_units(spark, d))


@register("complexity_features", """
SELECT uid, accesses, checks,
       CAST(accesses - least(checks, accesses) AS DOUBLE) AS bounds_score,
       len(list_distinct(ops)) AS n1, len(list_distinct(opd)) AS n2, len(ops) AS N1, len(opd) AS N2,
       CASE WHEN len(list_distinct(opd)) = 0 THEN 0.0
            ELSE CAST(len(list_distinct(ops)) * len(opd) AS DOUBLE) / CAST(len(list_distinct(opd)) * 2 AS DOUBLE) END
         AS halstead_difficulty
FROM (SELECT uid, len(regexp_extract_all(code, '[A-Za-z_]\\w*\\s*\\[', 0)) AS accesses,
             len(regexp_extract_all(code, '\\b(?:if|while)\\s*\\([^)]*[<>]', 0)) AS checks,
             regexp_extract_all(code, '""" + RU.HALSTEAD_OPERATORS.replace("'", "''") + """', 0) AS ops,
             regexp_extract_all(code, '""" + RU.HALSTEAD_OPERANDS.replace("'", "''") + """', 0) AS opd
      FROM v_code_units) x""")
def complexity_features(spark, d):
    """X5 bounds-check score and X7 Halstead counts/difficulty.  The names n1 and N1, n2 and N2 differ
    by case alone, so the result belongs to a session that tells them apart and can write them;
    who reads what it wrote needs spark.sql.caseSensitive too."""
    return RU.complexity_features(code_units(case_sensitive(spark), d))


_STATE_SQL = "{{'tok': {0}, 'nest': {1}, 'pend': {2}, 'score': {3}, 'stack': {4}}}"


@register("cognitive_complexity", f"""
WITH t AS (SELECT uid, regexp_extract_all(code, '\\b(?:{'|'.join(RU.CONTROL_KW)})\\b|[{{}}]', 0) AS toks FROM v_code_units),
s AS (SELECT uid, list_transform(list_prepend('', toks), lambda x: {_STATE_SQL.format('x', '0', 'FALSE', '0', '[]::BOOLEAN[]')}) AS st FROM t)
SELECT uid, list_reduce(st, lambda s, t: CASE
  WHEN t.tok = '{{' THEN {_STATE_SQL.format('t.tok', 's.nest + CASE WHEN s.pend THEN 1 ELSE 0 END', 'FALSE', 's.score', 'list_append(s.stack, s.pend)')}
  WHEN t.tok = '}}' THEN {_STATE_SQL.format('t.tok', 's.nest - CASE WHEN coalesce(s.stack[len(s.stack)], FALSE) THEN 1 ELSE 0 END', 's.pend', 's.score', 's.stack[1:len(s.stack) - 1]')}
  ELSE {_STATE_SQL.format('t.tok', 's.nest', 'TRUE', 's.score + 1 + s.nest', 's.stack')} END).score AS cognitive_complexity
FROM s""")
def cognitive_complexity(spark, d):
    """Control keywords weighted by control-brace nesting (fold over tokens)."""
    return RU.cognitive_complexity(code_units(spark, d))


def source_files(spark, d):
    """pages as source files plus the C sample assembled into its two files."""
    files: dict[str, list[str]] = {}
    for f, n, st, c in C_SAMPLE:
        files.setdefault(f, []).append(c)
    sample = spark.createDataFrame([(f, "\n\n".join(cs)) for f, cs in files.items()], "path string, content string")
    pages = V.table(spark, d, "pages").select(F.col("url").alias("path"), F.col("html").alias("content"))
    return pages.unionByName(sample)


#: name, first and last line of the functions of the C sample's two files, read off the text
_SAMPLE_FUNCTIONS = [("sample/net.c", "copy_name", 1, 5), ("sample/net.c", "run_tool", 7, 11), ("sample/net.c", "parse_len", 13, 20),
                     ("sample/mem.c", "reuse", 1, 6), ("sample/mem.c", "race", 8, 14), ("sample/mem.c", "walk", 16, 22)]


@register("segment_units", """
SELECT f.* FROM (VALUES """ + ", ".join(f"('{f}', '{n}', CAST({a} AS BIGINT), CAST({b} AS BIGINT))" for f, n, a, b in _SAMPLE_FUNCTIONS)
          + """) AS f(file_path, function_name, start_line, end_line)
UNION ALL SELECT url, 'page', 0, 0 FROM pages WHERE regexp_matches(html, '[A-Za-z_]\\w*\\s*\\([^(){};]*\\)\\s*\\{')""")
def segment_units(spark, d):
    """Functions of all pages (markup: none has one) and of the C sample's files."""
    return RU.segment_units(source_files(spark, d)).drop("code")


#: Heads of the generated sources by doc_id % 10 (@ is the doc_id): text, name ('' if it is no function), first line, line of the brace.
HEADS = [
    ("int f@(int a, char *b)", "f@", 1, 2),
    ("int f@(a, b)\nint a;\nchar *b;", "f@", 1, 4),
    ("__attribute__((noinline)) static int f@(void)", "f@", 1, 2),
    ("int f@(void) __must_hold(x) UNUSED(y)", "f@", 1, 2),
    ('MODULE_LICENSE("GPL");\nMODULE_NOTE(x)\nstatic void *f@(void)', "f@", 3, 4),
    ("template <class T, int N = (1 > 2)>\nT A<T>::f@(T t) const", "A::f@", 2, 3),
    ("void (*f@(int s, void (*g)(int)))(int)", "f@", 1, 2),
    ("#ifdef WIDE\nlong f@(long x)\n#else\nint f@(int x)\n#endif", "f@", 2, 6),
    ("DEFINE_THING(f@)", "", 1, 2),
    ("B::B(int x) : a(x), b{x}, c{f(x)}", "B::B", 1, 2),
]


def generated_sources(spark, d):
    """A source file for each document: a head of every kind, the text as a comment of the body."""
    docs = V.table(spark, d, "documents").select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("*/"), F.lit("* /")).alias("text"))
    head = F.get(F.array(*[F.lit(h) for h, *_ in HEADS]), F.pmod("doc_id", F.lit(len(HEADS))).cast("int"))
    body = F.concat(F.lit("\n{\n/* "), F.col("text"), F.lit(' */\nconst char *s = "} {"; if (s) { x = \'{\'; }\n}\n'))
    return docs.select(F.concat(F.lit("gen/"), F.col("doc_id"), F.lit(".c")).alias("path"), F.concat(F.replace(head, F.lit("@"), F.col("doc_id").cast("string")), body).alias("content"))


DECLARATORS_SQL = """
WITH h(k, name, first, brace) AS (VALUES """ + ", ".join(f"({k}, '{n}', {a}, {b})" for k, (_, n, a, b) in enumerate(HEADS)) + """),
d AS (SELECT doc_id, replace(coalesce(text, ''), '*/', '* /') AS text FROM documents)
SELECT 'gen/' || doc_id || '.c' AS file_path, replace(name, '@', doc_id::VARCHAR) AS function_name, first::BIGINT AS start_line,
       (brace + 3 + length(text) - length(replace(text, chr(10), '')))::BIGINT AS end_line
FROM d JOIN h ON h.k = d.doc_id % """ + str(len(HEADS)) + " WHERE name <> ''"


@register("segment_declarators", DECLARATORS_SQL)
def segment_declarators(spark, d):
    """U2 over a generated source per document: old-style, attribute, macro, template, pointer,
    conditional and qualified heads; SQL knows only the head's name and lines and the text's newlines."""
    return RU.segment_units(generated_sources(spark, d)).drop("code")

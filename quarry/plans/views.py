"""Demo views over the driver tables, in Spark and as DuckDB CTE text.

The driver's tables are TPC-H-like plus text tables; the reference's data
model (corpus records, function units, tool findings, scored predictions,
source files, job logs, raw datasets) is derived from them here.  Every view
reads whole tables, so work grows with the scale factor.

  v_corpus    documents LEFT JOIN labels -> canonical 7-column corpus + ordinal
  v_units     documents as functions, sources as files, stacked line ranges
  v_findings  events as tool findings placed on files/lines
  v_scored    labelled documents with four member scores and two stage scores
  v_files     pages as source files
  v_logs      events as job log entries
  v_raw_*     documents shaped like the four raw labelled datasets
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators.corpus import with_uid
from ..operators.helpers import ordered_scan
from ..sources.fixed import SEVERITY_CONFIDENCE

# FIXED VALUES (ours) — demo label list and member-score primes
CWE10 = ["CWE-119", "CWE-120", "CWE-125", "CWE-787", "CWE-416", "CWE-476", "CWE-190", "CWE-20", "CWE-78", "CWE-22"]
FINDING_CWES = ["CWE-120", "CWE-78", "CWE-476", "CWE-9999", None]
MEMBER_PRIMES = [7919, 104729, 1299709, 15485863]
STAGE_PRIMES = [31, 131]
MEMBER_WEIGHTS = [0.3, 0.25, 0.25, 0.2]
N_FILES = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cwe_of(doc_id) -> F.Column:
    return F.get(F.array(*[F.lit(c) for c in CWE10]), (doc_id % 12).cast("int"))


def _sql_list(vals) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in vals) + "]"


def _score(doc_id, label, p):
    return F.lit(0.3) * label + F.lit(0.7) * ((doc_id * p) % 1000).cast("double") / F.lit(1000.0)


def _score_sql(doc, label, p):
    return (f"CAST(0.3 AS DOUBLE) * {label} + CAST(0.7 AS DOUBLE) * CAST(({doc} * {p}) % 1000 AS DOUBLE)"
            f" / CAST(1000.0 AS DOUBLE)")


# ------------------------------------------------------------------ Spark views
def v_corpus(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    labels = table(spark, d, "labels").select(
        "doc_id", F.col("toxic").cast("int").alias("label_binary"), F.col("quality").cast("int").alias("label_quality"))
    j = docs.join(labels, "doc_id", "left")
    cve = F.when(
        F.col("doc_id") % 5 == 0,
        F.concat(F.lit("CVE-"), (F.lit(2010) + F.col("doc_id") % 13).cast("string"), F.lit("-"),
                 F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0")),
    )
    return j.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"),
        F.col("source").alias("dataset"), F.col("lang").alias("language"), F.col("text").alias("code"),
        "label_binary", _cwe_of(F.col("doc_id")).alias("label_cwe"), cve.alias("label_cve"),
        F.col("doc_id").alias("ordinal"), "label_quality",
    )


def v_units(spark: SparkSession, d: str) -> DataFrame:
    """One unit per document; file = source; units stacked with 3-line gaps.

    start_line is an exclusive running sum per file; every file is a hot key
    (20 files at any scale), so it runs through the bucketed scan
    rather than a per-file window.  Only the narrow (file, doc, n_lines)
    projection goes through the scan; the text joins back on doc_id.
    """
    docs = table(spark, d, "documents")
    narrow = docs.select(F.col("source").alias("file_path"), "doc_id",
                         TX.line_count("text").cast("long").alias("n_lines")).withColumn("_gap", F.col("n_lines") + 3)
    u = ordered_scan(narrow, ["doc_id"], "_gap", ["file_path"], "_before", inclusive=False)
    u = u.select("file_path", "doc_id", "n_lines", (F.col("_before") + 1).alias("start_line"))
    u = u.withColumn("end_line", F.col("start_line") + F.col("n_lines") - 1)
    u = u.withColumn("function_name", F.concat(F.lit("fn_"), F.col("doc_id").cast("string")))
    u = with_uid(u)
    text = docs.select("doc_id", F.col("text").alias("code"), F.col("lang").alias("language"))
    return u.join(text, "doc_id")


def v_findings(spark: SparkSession, d: str, units: DataFrame | None = None) -> DataFrame:
    units = v_units(spark, d) if units is None else units
    # scalar subquery (planned by Spark, no driver round trip)
    m = units.select((F.floor(F.max("end_line") * 11 / 10) + 1).cast("long")).scalar()
    ev = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    sev = (F.when(F.col("value") >= 100, "CRITICAL").when(F.col("value") >= 50, "HIGH")
           .when(F.col("value") >= 15, "MEDIUM").otherwise("LOW"))
    return ev.select(
        F.col("event_id").alias("finding_id"),
        F.col("event_type").alias("tool"),
        F.concat(F.col("event_type"), F.lit(":"), (k % 10).cast("string")).alias("rule_id"),
        F.get(F.array(*[F.lit(c).cast("string") for c in FINDING_CWES]), (F.col("event_id") % 5).cast("int")).alias("cwe_id"),
        F.concat(F.lit("src"), (F.col("user_id") % N_FILES).cast("string")).alias("file_path"),
        (F.lit(1) + (F.col("event_id") * 37) % m).alias("line"),
        (F.col("event_id") % 80 + 1).cast("int").alias("col"),
        sev.alias("severity"),
        F.concat(F.col("event_type"), F.lit(" finding "), F.col("props")).alias("message"),
    ).withColumn("confidence", TX.map_lookup("severity", SEVERITY_CONFIDENCE))


def v_scored(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    j = labels.join(docs, "doc_id", "inner")
    lab = F.col("toxic").cast("int")
    cols = [
        "doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"),
        F.col("lang").alias("language"), F.col("source").alias("dataset"), lab.alias("label"),
        _cwe_of(F.col("doc_id")).alias("category"),
    ]
    for i, p in enumerate(MEMBER_PRIMES, 1):
        cols.append(_score(F.col("doc_id"), lab, p).alias(f"s{i}"))
    for i, p in enumerate(STAGE_PRIMES, 1):
        cols.append(_score(F.col("doc_id"), lab, p).alias(f"stage{i}"))
    out = j.select(*cols)
    vote = None
    for w, i in zip(MEMBER_WEIGHTS, range(1, 5)):
        term = F.lit(w) * F.col(f"s{i}")
        vote = term if vote is None else vote + term
    return out.withColumn("score", vote)


def v_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(
        "page_id", F.col("url").alias("path"), F.col("html").alias("content"),
        F.octet_length("html").cast("long").alias("size"))


def v_logs(spark: SparkSession, d: str) -> DataFrame:
    lvl = (F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "DEBUG")
           .when(F.col("event_type") == "purchase", "WARNING").otherwise("INFO"))
    return table(spark, d, "events").select(
        F.col("event_id").alias("entry_id"), F.col("user_id").alias("job_id"), "ts", lvl.alias("level"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("msg"))


LABELLED_VARIANTS = ["_bad.c", "_good.c", "_goodG2B_1.c", "_good_2.cpp", "_helper.h", "_bad_3.cpp"]


def v_labelled_files(spark: SparkSession, d: str) -> DataFrame:
    """pages shaped like a labelled test-suite tree (category in the path)."""
    p = table(spark, d, "pages")
    cat = F.concat(F.lit("CWE"), (F.col("page_id") % 97 + 15).cast("string"))
    variant = F.get(F.array(*[F.lit(v) for v in LABELLED_VARIANTS]), (F.col("page_id") % len(LABELLED_VARIANTS)).cast("int"))
    path = F.concat(F.lit("testcases/"), cat, F.lit("_demo/s01/"), cat, F.lit("_demo__"), F.col("page_id").cast("string"), variant)
    return p.select("page_id", path.alias("path"), F.col("html").alias("content"),
                    F.lit("suite").alias("project"), F.lit(None).cast("string").alias("commit_id"))


def _raw_base(spark, d):
    docs = table(spark, d, "documents")
    labels = table(spark, d, "labels").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    return docs.join(labels, "doc_id", "left")


def v_raw_zenodo(spark, d):
    b = _raw_base(spark, d)
    lang = (F.when(F.col("lang") == "en", "C").when(F.col("lang") == "fr", " C++ ")
            .when(F.col("lang") == "de", "c").otherwise("Python"))
    return b.select(
        F.col("doc_id").alias("ordinal"),
        F.when(F.col("doc_id") % 17 == 0, F.lit("   ")).otherwise(F.col("text")).alias("vul_code"),
        (F.col("toxic") == 1).alias("is_vulnerable"), lang.alias("programming_language"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(_cwe_of(F.col("doc_id"))).alias("cwe_id"),
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("CVE-2019-"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0")))
        .alias("cve_id"))


def v_raw_devign(spark, d):
    b = _raw_base(spark, d)
    return b.select(
        F.col("doc_id").alias("ordinal"),
        F.when(F.col("doc_id") % 19 == 0, F.lit(None).cast("string")).otherwise(F.col("text")).alias("func"),
        F.col("toxic").alias("target"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("c"), (F.col("doc_id") % 50).cast("string"))).alias("commit_id"))


def v_raw_diversevul(spark, d):
    b = _raw_base(spark, d)
    cwe = (F.when(F.col("doc_id") % 4 == 0, F.lit('["CWE-120", "CWE-787"]')).when(F.col("doc_id") % 4 == 1, F.lit("[]"))
           .when(F.col("doc_id") % 4 == 2, F.lit("CWE-416")))
    msg = F.concat(F.lit("fix CVE-2018-"), (F.lit(1000) + F.col("doc_id") * 7 % 999000).cast("string"), F.lit(" in parser"))
    return b.select(
        F.col("doc_id").alias("ordinal"),
        F.when(F.col("doc_id") % 13 == 0, F.lit(" \n ")).otherwise(F.col("text")).alias("func"),
        F.col("toxic").alias("target"), cwe.alias("cwe"), msg.alias("message"))


def v_raw_megavul(spark, d):
    b = _raw_base(spark, d)
    cwe = (F.when(F.col("doc_id") % 3 == 0, F.lit('["CWE-125"]')).when(F.col("doc_id") % 3 == 1, F.lit("CWE-20")))
    return b.select(
        F.col("doc_id").alias("ordinal"), F.col("text").alias("func"), (F.col("toxic") == 1).alias("is_vul"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("CVE-2021-"), (F.col("doc_id") % 10000).cast("string"))).alias("cve_id"),
        cwe.alias("cwe_ids"))


# ------------------------------------------------------------------ DuckDB CTE text
_CWE10_SQL = _sql_list(CWE10)
_FCWE_SQL = _sql_list(FINDING_CWES)

SQL_VIEWS: dict[str, tuple[list[str], str]] = {
    "v_corpus": ([], f"""
SELECT 'doc_' || CAST(d.doc_id AS VARCHAR) AS id, d.source AS dataset, d.lang AS language, d.text AS code,
       CAST(l.toxic AS INTEGER) AS label_binary, {_CWE10_SQL}[d.doc_id % 12 + 1] AS label_cwe,
       CASE WHEN d.doc_id % 5 = 0 THEN 'CVE-' || CAST(2010 + d.doc_id % 13 AS VARCHAR) || '-'
            || lpad(CAST(d.doc_id % 10000 AS VARCHAR), 4, '0') END AS label_cve,
       d.doc_id AS ordinal, CAST(l.quality AS INTEGER) AS label_quality
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "v_units": ([], """
SELECT *, start_line + n_lines - 1 AS end_line,
       file_path || '::' || function_name || '::' || CAST(start_line AS VARCHAR) AS uid
FROM (
  SELECT *, CAST(1 + coalesce(sum(n_lines + 3) OVER (PARTITION BY file_path ORDER BY doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_line
  FROM (SELECT source AS file_path, 'fn_' || CAST(doc_id AS VARCHAR) AS function_name, text AS code, doc_id,
               lang AS language, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n_lines
        FROM documents) u0) u1"""),
    "v_findings": (["v_units"], f"""
SELECT e.event_id AS finding_id, e.event_type AS tool,
       e.event_type || ':' || CAST(CAST(json_extract_string(e.props, '$.k') AS BIGINT) % 10 AS VARCHAR) AS rule_id,
       {_FCWE_SQL}[e.event_id % 5 + 1] AS cwe_id,
       'src' || CAST(e.user_id % {N_FILES} AS VARCHAR) AS file_path,
       1 + (e.event_id * 37) % (SELECT CAST(floor(max(end_line) * 11 / 10) + 1 AS BIGINT) FROM v_units) AS line,
       CAST(e.event_id % 80 + 1 AS INTEGER) AS col,
       CASE WHEN e.value >= 100 THEN 'CRITICAL' WHEN e.value >= 50 THEN 'HIGH' WHEN e.value >= 15 THEN 'MEDIUM'
            ELSE 'LOW' END AS severity,
       e.event_type || ' finding ' || e.props AS message,
       CASE WHEN e.value >= 100 THEN 0.95 WHEN e.value >= 50 THEN 0.85 WHEN e.value >= 15 THEN 0.70
            ELSE 0.50 END::DOUBLE AS confidence
FROM events e"""),
    "v_scored": ([], f"""
SELECT *, {' + '.join(f'CAST({w} AS DOUBLE) * s{i}' for i, w in enumerate(MEMBER_WEIGHTS, 1))} AS score FROM (
SELECT l.doc_id, 'doc_' || CAST(l.doc_id AS VARCHAR) AS id, d.lang AS language, d.source AS dataset,
       CAST(l.toxic AS INTEGER) AS label, {_CWE10_SQL}[l.doc_id % 12 + 1] AS category,
       {', '.join(_score_sql('l.doc_id', 'CAST(l.toxic AS INTEGER)', p) + f' AS s{i}' for i, p in enumerate(MEMBER_PRIMES, 1))},
       {', '.join(_score_sql('l.doc_id', 'CAST(l.toxic AS INTEGER)', p) + f' AS stage{i}' for i, p in enumerate(STAGE_PRIMES, 1))}
FROM labels l JOIN documents d ON d.doc_id = l.doc_id) sc"""),
    "v_files": ([], "SELECT page_id, url AS path, html AS content, CAST(strlen(html) AS BIGINT) AS size FROM pages"),
    "v_logs": ([], """
SELECT event_id AS entry_id, user_id AS job_id, ts,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' WHEN 'purchase' THEN 'WARNING'
            ELSE 'INFO' END AS level, event_type || ' ' || props AS msg
FROM events"""),
    "v_labelled_files": ([], f"""
SELECT page_id, 'testcases/CWE' || CAST(page_id % 97 + 15 AS VARCHAR) || '_demo/s01/CWE' || CAST(page_id % 97 + 15 AS VARCHAR)
       || '_demo__' || CAST(page_id AS VARCHAR) || {_sql_list(LABELLED_VARIANTS)}[page_id % {len(LABELLED_VARIANTS)} + 1] AS path,
       html AS content, 'suite' AS project, CAST(NULL AS VARCHAR) AS commit_id
FROM pages"""),
    "v_raw_base": ([], """
SELECT d.*, CAST(l.toxic AS INTEGER) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "v_raw_zenodo": (["v_raw_base"], f"""
SELECT doc_id AS ordinal, CASE WHEN doc_id % 17 = 0 THEN '   ' ELSE text END AS vul_code,
       toxic = 1 AS is_vulnerable,
       CASE lang WHEN 'en' THEN 'C' WHEN 'fr' THEN ' C++ ' WHEN 'de' THEN 'c' ELSE 'Python' END AS programming_language,
       CASE WHEN doc_id % 3 = 0 THEN '' ELSE {_CWE10_SQL}[doc_id % 12 + 1] END AS cwe_id,
       CASE WHEN doc_id % 4 = 0 THEN 'CVE-2019-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') END AS cve_id
FROM v_raw_base"""),
    "v_raw_devign": (["v_raw_base"], """
SELECT doc_id AS ordinal, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE text END AS func, toxic AS target,
       CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'c' || CAST(doc_id % 50 AS VARCHAR) END AS commit_id
FROM v_raw_base"""),
    "v_raw_diversevul": (["v_raw_base"], """
SELECT doc_id AS ordinal, CASE WHEN doc_id % 13 = 0 THEN ' ' || chr(10) || ' ' ELSE text END AS func, toxic AS target,
       CASE doc_id % 4 WHEN 0 THEN '["CWE-120", "CWE-787"]' WHEN 1 THEN '[]' WHEN 2 THEN 'CWE-416' END AS cwe,
       'fix CVE-2018-' || CAST(1000 + doc_id * 7 % 999000 AS VARCHAR) || ' in parser' AS message
FROM v_raw_base"""),
    "v_raw_megavul": (["v_raw_base"], """
SELECT doc_id AS ordinal, text AS func, toxic = 1 AS is_vul,
       CASE WHEN doc_id % 2 = 0 THEN 'CVE-2021-' || CAST(doc_id % 10000 AS VARCHAR) END AS cve_id,
       CASE doc_id % 3 WHEN 0 THEN '["CWE-125"]' WHEN 1 THEN 'CWE-20' END AS cwe_ids
FROM v_raw_base"""),
}


def with_views(sql: str, extra: dict[str, tuple[list[str], str]] | None = None) -> str:
    """Prefix ``sql`` with the CTEs of every view it (transitively) mentions."""
    views = dict(SQL_VIEWS)
    if extra:
        views.update(extra)
    order: list[str] = []

    def need(name):
        if name in order:
            return
        for dep in views[name][0]:
            need(dep)
        order.append(name)

    text = sql
    changed = True
    while changed:
        changed = False
        for name in views:
            if name not in order and re.search(rf"\b{name}\b", text):
                need(name)
                text = text + " " + " ".join(views[n][1] for n in order)
                changed = True
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({views[n][1]}\n)" for n in order)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{sql}"

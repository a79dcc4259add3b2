"""Findings queries (J1-J6, J11, J13, D5-D7, D9, A14-A23, F7-F10, L1-L5) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import findings as FD
from ..sources.fixed import (
    CWE_CATEGORIES, CWE_DIM, SEVERITY_CONFIDENCE, SEVERITY_ORDER, UNKNOWN_CWE_MITIGATION, UNKNOWN_CWE_RECOMMENDATION,
    XML_TOOL_SECURITY_OVERRIDES, XML_TOOL_SKIP_SEVERITIES, XML_TOOL_SUPPRESS, sql_values,
)
from . import views as V
from .registry import register

# ------------------------------------------------------------------ SQL building blocks
_q = lambda xs: ", ".join("'" + x + "'" for x in xs)
V.SQL_VIEWS.update({
    "v_dim": ([], "SELECT * FROM " + sql_values(
        CWE_DIM, ["cwe_id", "cwe_name", "dim_severity", "cvss", "description", "mitigation", "example_fix"])),
    "v_cats": ([], "SELECT category, unnest(cwe_ids) AS cwe_id FROM " + sql_values(
        [(c, ids) for c, ids in CWE_CATEGORIES], ["category", "cwe_ids"])),
    "v_map": (["v_findings", "v_units"], """
SELECT finding_id, uid, 'contained' AS how FROM (
  SELECT f.finding_id, u.uid, row_number() OVER (PARTITION BY f.finding_id ORDER BY u.start_line, u.uid) AS rn
  FROM v_findings f JOIN v_units u ON f.file_path = u.file_path AND f.line BETWEEN u.start_line AND u.end_line) c
WHERE rn = 1
UNION ALL
SELECT finding_id, uid, 'nearest' AS how FROM (
  SELECT f.finding_id, u.uid,
         row_number() OVER (PARTITION BY f.finding_id ORDER BY abs(u.start_line - f.line), u.start_line, u.uid) AS rn
  FROM v_findings f JOIN v_units u ON f.file_path = u.file_path
  WHERE NOT EXISTS (SELECT 1 FROM v_units u2 WHERE u2.file_path = f.file_path
                    AND f.line BETWEEN u2.start_line AND u2.end_line)) n
WHERE rn = 1"""),
    "v_fu": (["v_map"], "SELECT f.*, m.uid FROM v_findings f JOIN v_map m USING (finding_id)"),
    "v_merged": (["v_fu"], """
SELECT uid, line, cwe_id, finding_id, rule_id, severity,
       CASE WHEN n > 1 THEN least(confidence + 0.05, 1.0) ELSE confidence END AS confidence,
       CASE WHEN n > 1 THEN '[' || array_to_string(tl, ', ') || '] ' || message ELSE message END AS message,
       CASE WHEN n > 1 THEN array_to_string(tl, '+') ELSE tool END AS tool, file_path, n AS n_merged
FROM (SELECT *, row_number() OVER (PARTITION BY uid, line, cwe_id ORDER BY confidence DESC, finding_id) AS rn,
             count(*) OVER (PARTITION BY uid, line, cwe_id) AS n,
             list_sort(list_distinct(list(tool) OVER (PARTITION BY uid, line, cwe_id))) AS tl
      FROM v_fu WHERE cwe_id IS NOT NULL) g
WHERE rn = 1
UNION ALL
SELECT uid, line, cwe_id, finding_id, rule_id, severity, confidence, message, tool, file_path, 1 AS n_merged
FROM v_fu WHERE cwe_id IS NULL"""),
    "v_verdict": (["v_merged"], """
SELECT uid, count(*) AS n_findings, max(confidence) AS max_confidence,
       arg_max(severity, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2
                                       WHEN 'LOW' THEN 1 ELSE 0 END) AS max_severity,
       count(*) > 0 AS is_vulnerable
FROM v_merged GROUP BY uid"""),
    "v_types": (["v_merged", "v_dim"], """
SELECT uid, string_agg(label, '; ' ORDER BY line, finding_id) AS cwe_types FROM (
  SELECT * FROM (SELECT uid, label, line, finding_id,
                        row_number() OVER (PARTITION BY uid, label ORDER BY line, finding_id) AS rn
                 FROM (SELECT m.uid, m.line, m.finding_id, m.cwe_id || ': ' || coalesce(d.cwe_name, 'None') AS label
                       FROM v_merged m LEFT JOIN v_dim d USING (cwe_id) WHERE m.cwe_id IS NOT NULL) a) b
  WHERE rn = 1) c GROUP BY uid"""),
    "v_results": (["v_units", "v_verdict", "v_types"], """
SELECT u.uid, u.function_name, u.file_path, u.start_line, coalesce(v.is_vulnerable, FALSE) AS is_vulnerable,
       coalesce(v.max_confidence, 0.0) AS confidence, coalesce(v.max_severity, 'LOW') AS severity,
       CAST(coalesce(v.n_findings, 0) AS BIGINT) AS n_findings, coalesce(t.cwe_types, '') AS cwe_types
FROM v_units u LEFT JOIN v_verdict v USING (uid) LEFT JOIN v_types t USING (uid)"""),
})


def _units(spark, d):
    return V.v_units(spark, d)


def _findings(spark, d, units=None):
    return V.v_findings(spark, d, units)


def _mapped(spark, d):
    u = _units(spark, d)
    f = _findings(spark, d, u)
    return u, f, FD.map_findings(f, u)


def _fu(spark, d):
    u = _units(spark, d)
    return u, FD.attach_units(_findings(spark, d, u), u)


def _merged(spark, d):
    u, fu = _fu(spark, d)
    return u, FD.merge_findings(fu)


def _results(spark, d):
    u, m = _merged(spark, d)
    return FD.static_results(u, m)


@register("map_findings", "SELECT finding_id, uid, how FROM v_map")
def map_findings(spark, d):
    """Finding -> unit: containing interval first, nearest start otherwise."""
    return _mapped(spark, d)[2]


@register("merge_findings", """
SELECT uid, line, cwe_id, finding_id, rule_id, severity, confidence, message, tool, file_path, n_merged FROM v_merged""")
def merge_findings(spark, d):
    return _merged(spark, d)[1]


@register("distinct_cwe_types", "SELECT uid, cwe_types FROM v_types")
def distinct_cwe_types(spark, d):
    _, m = _merged(spark, d)
    return FD.distinct_cwe_types(m).select("uid", F.array_join("cwe_types", "; ").alias("cwe_types"))


@register("clean_units", "SELECT uid FROM v_units WHERE uid NOT IN (SELECT uid FROM v_map)")
def clean_units(spark, d):
    u, f, m = _mapped(spark, d)
    return FD.clean_units(u, m).select("uid")


@register("flagged_units", "SELECT uid FROM v_units WHERE uid IN (SELECT uid FROM v_map)")
def flagged_units(spark, d):
    u, f, m = _mapped(spark, d)
    return FD.flagged_units(u, m).select("uid")


@register("enrich_findings", f"""
SELECT f.finding_id, f.cwe_id, d.cwe_name, d.dim_severity, d.cvss AS severity_score,
       CASE WHEN d.cwe_name IS NOT NULL THEN d.mitigation ELSE '{UNKNOWN_CWE_MITIGATION}' END AS mitigation,
       CASE WHEN d.cwe_name IS NOT NULL THEN d.example_fix ELSE '{UNKNOWN_CWE_RECOMMENDATION}' END AS recommendation, d.description
FROM v_findings f LEFT JOIN v_dim d USING (cwe_id)""")
def enrich_findings(spark, d):
    e = FD.enrich_findings(_findings(spark, d))
    return e.select("finding_id", "cwe_id", "cwe_name", "dim_severity", "severity_score", "mitigation", "recommendation", "description")


@register("unit_verdict", "SELECT uid, n_findings, max_confidence, max_severity, is_vulnerable FROM v_verdict")
def unit_verdict(spark, d):
    return FD.unit_verdict(_merged(spark, d)[1])


@register("static_results", "SELECT * FROM v_results")
def static_results(spark, d):
    return _results(spark, d)


@register("static_summary", """
SELECT 'total' AS kind, 'functions' AS key, count(*) AS value FROM v_results
UNION ALL SELECT 'total', 'vulnerable', count_if(is_vulnerable) FROM v_results
UNION ALL SELECT 'total', 'safe', count_if(NOT is_vulnerable) FROM v_results
UNION ALL SELECT 'total', 'findings', count(*) FROM v_merged
UNION ALL SELECT 'tool', tool, count(*) FROM v_merged GROUP BY tool
UNION ALL SELECT 'cwe', label, count(DISTINCT uid) FROM (
  SELECT m.uid, m.cwe_id || ': ' || coalesce(d.cwe_name, 'None') AS label
  FROM v_merged m LEFT JOIN v_dim d USING (cwe_id) WHERE m.cwe_id IS NOT NULL) c GROUP BY label""")
def static_summary(spark, d):
    """Totals, findings per tool, units per cwe_types entry (kind, key, value)."""
    return FD.static_summary(FD.static_report(*_merged(spark, d)))


@register("static_report", """
WITH fj AS (SELECT m.uid, string_agg(m.tool || '|' || m.message || '|' || m.severity || '|' || coalesce(m.cwe_id, 'N/A') || '|' || coalesce(d.cwe_name, ''),
                                     '; ' ORDER BY m.line, m.finding_id) AS findings
            FROM v_merged m LEFT JOIN v_dim d USING (cwe_id) GROUP BY m.uid)
SELECT r.uid, r.function_name, r.file_path, r.start_line AS line_number,
       CASE WHEN length(u.code) > 500 THEN substr(u.code, 1, 500) || '...' ELSE u.code END AS code_snippet,
       r.is_vulnerable AS static_vulnerable, r.confidence AS static_confidence, r.severity,
       coalesce(fj.findings, '') AS static_findings, r.cwe_types
FROM v_results r JOIN v_units u USING (uid) LEFT JOIN fj USING (uid)""")
def static_report(spark, d):
    """The nested report rows, the nested parts printed."""
    r = FD.static_report(*_merged(spark, d))
    one = lambda x: F.concat_ws("|", x["tool"], x["message"], x["severity"], F.coalesce(x["cwe_id"], F.lit("N/A")), F.coalesce(x["cwe_name"], F.lit("")))
    return (r.withColumn("static_findings", F.array_join(F.transform("static_findings", one), "; "))
            .withColumn("cwe_types", F.array_join("cwe_types", "; ")))


@register("report_metadata", """
SELECT (SELECT count(*) FROM v_files) AS files, (SELECT count(*) FROM v_results) AS functions,
       (SELECT count_if(is_vulnerable) FROM v_results) AS static_vulnerable, (SELECT count_if(NOT is_vulnerable) FROM v_results) AS static_safe,
       (SELECT count_if(score >= 0.5) FROM v_scored) AS ml_vulnerable, (SELECT count_if(NOT (score >= 0.5)) FROM v_scored) AS ml_safe,
       CAST(0.5 AS DOUBLE) AS threshold, 'ensemble' AS ml_model""")
def report_metadata(spark, d):
    """Metadata and both summaries of a report (its time stamp left out)."""
    r = FD.report_metadata(FD.static_report(*_merged(spark, d)), _ml(spark, d), V.v_files(spark, d), 0.5)
    return r.select(
        F.col("metadata.total_files_analyzed").alias("files"), F.col("metadata.total_functions_analyzed").alias("functions"),
        F.col("static_summary.total_vulnerable").alias("static_vulnerable"), F.col("static_summary.total_safe").alias("static_safe"),
        F.col("ml_summary.total_vulnerable").alias("ml_vulnerable"), F.col("ml_summary.total_safe").alias("ml_safe"),
        "metadata.threshold", "metadata.ml_model")


@register("severity_histogram", f"""
SELECT o.severity, o.ord, coalesce(c.n, 0) AS n
FROM {sql_values([(s, i) for i, s in enumerate(SEVERITY_ORDER)], ['severity', 'ord'])}
LEFT JOIN (SELECT severity, count(*) AS n FROM v_results WHERE is_vulnerable GROUP BY severity) c ON o.severity = c.severity"""
          .replace(") AS t(severity, ord)", ") AS o(severity, ord)"))
def severity_histogram(spark, d):
    return FD.severity_histogram(_results(spark, d))


@register("findings_by_tool", "SELECT tool, count(*) AS n FROM v_findings GROUP BY tool")
def findings_by_tool(spark, d):
    return FD.findings_by_tool(_findings(spark, d))


@register("category_rollup", """
SELECT coalesce(c.category, 'uncategorized') AS category, count(*) AS n
FROM v_findings f LEFT JOIN v_cats c USING (cwe_id) GROUP BY 1""")
def category_rollup(spark, d):
    return FD.category_rollup(_findings(spark, d)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@register("cube_report", """
SELECT f.tool, f.severity, coalesce(c.category, 'uncategorized') AS category, count(*) AS n,
       grouping(f.tool, f.severity, coalesce(c.category, 'uncategorized')) AS gid
FROM v_findings f LEFT JOIN v_cats c USING (cwe_id)
GROUP BY CUBE (f.tool, f.severity, coalesce(c.category, 'uncategorized'))""")
def cube_report(spark, d):
    """tool x severity x category totals in one pass (replaces separate counts)."""
    return FD.cube_report(FD.category_rollup(_findings(spark, d)))


@register("untracked_categories", "SELECT DISTINCT cwe_id FROM v_findings WHERE cwe_id IS NOT NULL EXCEPT SELECT cwe_id FROM v_dim")
def untracked_categories(spark, d):
    return FD.untracked_categories(_findings(spark, d))


# ------------------------------------------------------------------ report paths
V.SQL_VIEWS["v_report"] = (["v_findings"], """
SELECT finding_id, CASE WHEN finding_id % 7 = 0 THEN 'other/none.c'
                        WHEN finding_id % 3 = 0 THEN file_path
                        WHEN finding_id % 3 = 1 THEN '/abs/checkout/' || file_path
                        ELSE 'x' || file_path END AS path
FROM v_findings""")


def _report(spark, d):
    f = _findings(spark, d)
    path = (F.when(F.col("finding_id") % 7 == 0, F.lit("other/none.c"))
            .when(F.col("finding_id") % 3 == 0, F.col("file_path"))
            .when(F.col("finding_id") % 3 == 1, F.concat(F.lit("/abs/checkout/"), F.col("file_path")))
            .otherwise(F.concat(F.lit("x"), F.col("file_path"))))
    return f.select("finding_id", path.alias("path"))


@register("resolve_report_paths", """
WITH fl AS (SELECT DISTINCT file_path AS rel_path, '/abs/checkout/' || file_path AS abs_path FROM v_units WHERE file_path <> 'src3'
            UNION SELECT DISTINCT 'x' || file_path, '/abs/checkout/x' || file_path FROM v_units WHERE file_path = 'src4'),
ex AS (SELECT r.finding_id, r.path, min(fl.rel_path) AS rel_path FROM v_report r JOIN fl ON r.path = fl.abs_path GROUP BY 1, 2),
sx AS (SELECT r.finding_id, r.path, min(fl.rel_path) AS rel_path FROM v_report r JOIN fl ON ends_with(r.path, fl.rel_path)
       WHERE r.finding_id NOT IN (SELECT finding_id FROM ex) GROUP BY r.finding_id, r.path)
SELECT * FROM ex UNION ALL SELECT * FROM sx""")
def resolve_report_paths(spark, d):
    """Absolute path first, then the smallest rel_path that ends the report path."""
    u = _units(spark, d).select("file_path").distinct()
    names = u.filter("file_path <> 'src3'").union(u.filter("file_path = 'src4'").select(F.concat(F.lit("x"), "file_path")))
    files = names.select(F.col("file_path").alias("rel_path"), F.concat(F.lit("/abs/checkout/"), "file_path").alias("abs_path"))
    return FD.resolve_report_paths(_report(spark, d), files, abs_col="abs_path").select("finding_id", "path", "rel_path")


# ------------------------------------------------------------------ tool noise filter
NOISE_IDS = ["nullPointer", "missingInclude", "uninitvar", "unusedVariable", "memleak", "checkersReport",
             "constParameter", "bufferAccessOutOfBounds", "unknownMacro", "shadowVariable", "zerodiv", "redundantAssignment"]
TOOL_SEV = {"error": "error", "view": "style", "click": "warning", "purchase": "information", "signup": "performance"}


def _xml_report(spark, d):
    ev = V.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return ev.select(
        F.col("event_id").alias("finding_id"),
        F.get(F.array(*[F.lit(x) for x in NOISE_IDS]), (k % len(NOISE_IDS)).cast("int")).alias("rule_id"),
        TX.map_lookup("event_type", TOOL_SEV).alias("tool_severity"),
        F.when(F.col("event_id") % 11 == 0, F.lit(0)).otherwise(F.col("event_id") % 500 + 1).alias("line"))


@register("tool_noise_filter", f"""
WITH r AS (SELECT event_id AS finding_id,
                  [{_q(NOISE_IDS)}][CAST(json_extract_string(props, '$.k') AS BIGINT) % {len(NOISE_IDS)} + 1] AS rule_id,
                  CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in TOOL_SEV.items())} END AS tool_severity,
                  CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id % 500 + 1 END AS line FROM events)
SELECT finding_id, rule_id, tool_severity, line,
       CASE tool_severity WHEN 'error' THEN 'HIGH' WHEN 'warning' THEN 'MEDIUM' ELSE 'MEDIUM' END AS severity,
       CASE (CASE tool_severity WHEN 'error' THEN 'HIGH' ELSE 'MEDIUM' END)
            {' '.join(f"WHEN '{a}' THEN {b}" for a, b in SEVERITY_CONFIDENCE.items())} ELSE 0.5 END::DOUBLE AS confidence
FROM r WHERE rule_id NOT IN ({_q(XML_TOOL_SUPPRESS)})
  AND (tool_severity NOT IN ({_q(XML_TOOL_SKIP_SEVERITIES)}) OR rule_id IN ({_q(XML_TOOL_SECURITY_OVERRIDES)}))
  AND line <> 0""")
def tool_noise_filter(spark, d):
    return FD.tool_noise_filter(_xml_report(spark, d))


# ------------------------------------------------------------------ ranking and UI filters
@register("top_flagged", "SELECT uid, confidence FROM v_results WHERE is_vulnerable ORDER BY confidence DESC, uid LIMIT 20")
def top_flagged(spark, d):
    return FD.top_flagged(_results(spark, d), 20).select("uid", "confidence")


@register("least_suspicious", "SELECT uid, confidence FROM v_results WHERE NOT is_vulnerable ORDER BY confidence, uid LIMIT 5")
def least_suspicious(spark, d):
    return FD.least_suspicious(_results(spark, d), 5).select("uid", "confidence")


@register("ranked_results", """
SELECT uid, row_number() OVER (ORDER BY is_vulnerable DESC, confidence DESC, uid) AS rank FROM v_results""")
def ranked_results(spark, d):
    """Flagged first, then confidence desc: a distributed global rank (no single-partition window)."""
    return FD.ranked_results(_results(spark, d))


@register("limit_files", "SELECT path, size FROM v_files ORDER BY path LIMIT 10")
def limit_files(spark, d):
    return V.v_files(spark, d).orderBy("path").limit(10).select("path", "size")


@register("sort_findings", """
SELECT uid, line, finding_id, row_number() OVER (PARTITION BY uid ORDER BY line, finding_id) AS pos FROM v_merged""")
def sort_findings(spark, d):
    _, m = _merged(spark, d)
    return FD.sort_findings(m.select("uid", "line", "finding_id"))


@register("filter_results", "SELECT uid FROM v_results WHERE is_vulnerable AND severity IN ('CRITICAL', 'HIGH')")
def filter_results(spark, d):
    return FD.filter_results(_results(spark, d), True, ["CRITICAL", "HIGH"]).select("uid")


@register("filter_log_level", "SELECT entry_id, level FROM v_logs WHERE level <> 'DEBUG'")
def filter_log_level(spark, d):
    return FD.filter_log_level(V.v_logs(spark, d)).select("entry_id", "level")


@register("vulnerable_split", """
SELECT is_vulnerable, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM v_results GROUP BY is_vulnerable""")
def vulnerable_split(spark, d):
    r = _results(spark, d)
    return r.groupBy("is_vulnerable").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


@register("vulnerability_rate", """
SELECT count(*) AS total, count_if(is_vulnerable) AS flagged,
       round(CAST(count_if(is_vulnerable) AS DOUBLE) * 100.0 / CAST(count(*) AS DOUBLE), 6) AS rate FROM v_results""")
def vulnerability_rate(spark, d):
    return FD.vulnerability_rate(_results(spark, d))


# ------------------------------------------------------------------ detector agreement (J11 + A21)
def _ml(spark, d):
    s = V.v_scored(spark, d)
    return s.select(F.concat(F.lit("fn_"), F.col("doc_id").cast("string")).alias("function_name"), "score",
                    (F.col("score") >= 0.5).alias("flagged"))


@register("detector_agreement", """
WITH ml AS (SELECT 'fn_' || CAST(doc_id AS VARCHAR) AS function_name, score, score >= 0.5 AS flagged FROM v_scored),
j AS (SELECT r.uid, r.is_vulnerable AS s, coalesce(ml.flagged, FALSE) AS m, r.confidence AS sc, coalesce(ml.score, 0.0) AS mc
      FROM v_results r LEFT JOIN ml USING (function_name))
SELECT CASE WHEN s AND m THEN 'Both' WHEN m THEN 'ML only' WHEN s THEN 'Static only' ELSE 'None' END AS agreement,
       count(*) AS n, count_if(s OR m) AS vulnerable, round(avg(greatest(sc, mc)), 6) AS avg_confidence
FROM j GROUP BY 1""")
def detector_agreement(spark, d):
    r = _results(spark, d)
    ml = _ml(spark, d)
    # the unit key of this data is the function's name
    a = FD.detector_agreement(r, ml, key="function_name")
    return a.groupBy("agreement").agg(F.count(F.lit(1)).alias("n"), F.count_if("vulnerable").alias("vulnerable"),
                                      F.round(F.avg("confidence"), 6).alias("avg_confidence"))


@register("ml_summary", """
WITH s AS (SELECT score, score >= 0.5 AS flagged,
                  CASE WHEN NOT (score >= 0.5) THEN 'N/A' WHEN score >= 0.85 THEN 'CRITICAL' WHEN score >= 0.65 THEN 'HIGH'
                       WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM v_scored)
SELECT count(*) AS total, count_if(flagged) AS flagged, count_if(severity = 'CRITICAL') AS critical,
       count_if(severity = 'HIGH') AS high, count_if(severity = 'MEDIUM') AS medium, count_if(severity = 'LOW') AS low,
       round(coalesce(avg(CASE WHEN flagged THEN score END), 0.0), 6) AS avg_confidence,
       round(coalesce(avg(CASE WHEN flagged THEN score END), 0.0), 4) AS avg_confidence_4
FROM s""")
def ml_summary(spark, d):
    """Ensemble / window-model summary: totals, severity counts, mean confidence of flagged rows."""
    s = V.v_scored(spark, d).withColumn("flagged", F.col("score") >= 0.5)
    s = s.withColumn("severity", FD.ml_severity("score", "flagged"))
    return FD.ml_summary(s)


@register("ml_severity", """
SELECT id, CASE WHEN NOT (score >= 0.5) THEN 'N/A' WHEN score >= 0.85 THEN 'CRITICAL' WHEN score >= 0.65 THEN 'HIGH'
                WHEN score >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM v_scored""")
def ml_severity(spark, d):
    """Window-model banding (MEDIUM from 0.45)."""
    s = V.v_scored(spark, d).withColumn("flagged", F.col("score") >= 0.5)
    return s.select("id", FD.ml_severity("score", "flagged", 0.45).alias("severity"))


@register("report_counts", """
WITH ml AS (SELECT 'fn_' || CAST(doc_id AS VARCHAR) AS function_name, score >= 0.5 AS flagged FROM v_scored),
j AS (SELECT r.*, coalesce(ml.flagged, FALSE) AS ml_flag FROM v_results r LEFT JOIN ml USING (function_name))
SELECT count(*) AS total_functions, count_if(is_vulnerable) AS static_flagged, count_if(ml_flag) AS ml_flagged,
       count_if(is_vulnerable AND ml_flag) AS both_flagged, CAST(sum(n_findings) AS BIGINT) AS total_findings,
       round(coalesce(avg(CASE WHEN is_vulnerable THEN confidence END), 0.0), 6) AS avg_static_confidence FROM j""")
def report_counts(spark, d):
    """Report metadata and summaries (flagged lists stay DataFrames for the JSON sink)."""
    r = _results(spark, d)
    ml = _ml(spark, d).select("function_name", F.col("flagged").alias("ml_flag"))
    j = r.join(ml, "function_name", "left").withColumn("ml_flag", F.coalesce("ml_flag", F.lit(False)))
    return j.agg(
        F.count(F.lit(1)).alias("total_functions"), F.count_if("is_vulnerable").alias("static_flagged"),
        F.count_if("ml_flag").alias("ml_flagged"), F.count_if(F.col("is_vulnerable") & F.col("ml_flag")).alias("both_flagged"),
        F.sum("n_findings").cast("long").alias("total_findings"),
        F.round(F.coalesce(F.avg(F.when(F.col("is_vulnerable"), F.col("confidence"))), F.lit(0.0)), 6).alias("avg_static_confidence"))


@register("severity_maps", """
WITH e AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'style' END AS xml_level,
                  CAST(floor(value / 100) AS INTEGER) % 6 AS csv_level,
                  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'info' ELSE 'Warning' END AS json_level FROM events),
s AS (SELECT event_id,
             CASE xml_level WHEN 'error' THEN 'HIGH' WHEN 'warning' THEN 'MEDIUM' ELSE 'MEDIUM' END AS xml_severity,
             CASE csv_level WHEN 5 THEN 'CRITICAL' WHEN 4 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END AS csv_severity,
             CASE upper(json_level) WHEN 'ERROR' THEN 'HIGH' WHEN 'WARNING' THEN 'MEDIUM' ELSE 'LOW' END AS json_severity FROM e)
SELECT event_id, xml_severity, csv_severity, json_severity,
       CASE csv_severity WHEN 'CRITICAL' THEN 0.95 WHEN 'HIGH' THEN 0.85 WHEN 'MEDIUM' THEN 0.7 ELSE 0.5 END::DOUBLE AS csv_confidence
FROM s""")
def severity_maps(spark, d):
    """The three tool level vocabularies mapped to severity, then confidence."""
    ev = V.table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warning")
        .otherwise("style").alias("xml_level"),
        (F.floor(F.col("value") / 100).cast("int") % 6).alias("csv_level"),
        F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "info")
        .otherwise("Warning").alias("json_level"))
    x = FD.with_severity(ev, "xml_level", "xml").withColumnRenamed("severity", "xml_severity")
    x = FD.with_severity(x, "json_level", "json").withColumnRenamed("severity", "json_severity")
    x = FD.with_confidence(FD.with_severity(x, "csv_level", "csv")).withColumnRenamed("severity", "csv_severity")
    return x.select("event_id", "xml_severity", "csv_severity", "json_severity", F.col("confidence").alias("csv_confidence"))

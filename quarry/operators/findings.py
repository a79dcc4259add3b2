"""Findings: map to units by line interval, merge, enrich, summarise, rank.

Shuffle plan (large axis = findings and units):
  map_findings   range join of keys on (file, block), then one ordered fill per
                 (file, range) for the findings outside every unit
  merge_findings one hash aggregate on (uid, line, cwe); per-group lists are
                 bounded by the number of tools
  unit_verdict   one hash aggregate on uid
  enrich         broadcast of the fixed 30-row dimension
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.fixed import (
    SEVERITY_CONFIDENCE, SEVERITY_ORDER, SEVERITY_RANK, UNKNOWN_CWE_MITIGATION, UNKNOWN_CWE_RECOMMENDATION,
    XML_TOOL_SECURITY_OVERRIDES, XML_TOOL_SEVERITY, XML_TOOL_SKIP_SEVERITIES, XML_TOOL_SUPPRESS, cwe_categories, cwe_dim,
)
from ..functions import text as TX
from .helpers import bucketed_range_join, global_rank, ordered_fill, settle


def severity_rank(c: str = "severity"):
    return TX.map_lookup(c, SEVERITY_RANK, 0)


# ---------------------------------------------------------------- J1 + J2
def map_findings(findings: DataFrame, units: DataFrame, bucket: int = 256) -> DataFrame:
    """finding_id -> uid: first unit (by start_line) containing the line, else the
    nearest unit start in the file (ties to the earlier start).  Findings in
    files without units are dropped.  Returns (finding_id, uid, how).

    Only keys travel: the range join and the first unit of each finding are written once,
    and the rest take the nearest start from one ordered fill per file."""
    u = units.select("uid", "file_path", "start_line", "end_line")
    keys = findings.select("finding_id", "file_path", "line")
    hits = bucketed_range_join(keys, u, "file_path", "line", "start_line", "end_line", bucket)
    first = hits.groupBy("finding_id").agg(F.min(F.struct("start_line", "uid"))["uid"].alias("uid"))
    placed = settle(keys.join(first, "finding_id", "left"), "contained")
    contained = placed.filter(F.col("uid").isNotNull()).select("finding_id", "uid", F.lit("contained").alias("how"))

    # predecessor start (<= line) and successor start (> line) of the rest
    rest = placed.filter(F.col("uid").isNull()).select("file_path", F.col("line").cast("long").alias("pos"), "finding_id", F.lit(1).alias("_k"))
    unit = F.struct(F.col("start_line").cast("long").alias("start"), F.col("_uid").alias("uid"))
    starts = u.groupBy("file_path", "start_line").agg(F.min("uid").alias("_uid"))
    ups = starts.select("file_path", F.col("start_line").cast("long").alias("pos"), F.lit(-1).cast("long").alias("finding_id"), F.lit(0).alias("_k"), unit.alias("_u"))
    both = rest.unionByName(ups, allowMissingColumns=True)  # units first at equal line
    near = ordered_fill(both, ["pos", "_k", "finding_id"], "_u", ["file_path"], "_pred", "_succ").filter("_k = 1")
    dp = F.col("pos") - F.col("_pred.start")
    ds = F.col("_succ.start") - F.col("pos")
    chosen = (F.when(F.col("_pred").isNull(), F.col("_succ.uid")).when(F.col("_succ").isNull(), F.col("_pred.uid"))
              .when(dp <= ds, F.col("_pred.uid")).otherwise(F.col("_succ.uid")))
    nearest = near.select("finding_id", chosen.alias("uid"), F.lit("nearest").alias("how")).filter(F.col("uid").isNotNull())
    return contained.unionByName(nearest)


def attach_units(findings: DataFrame, units: DataFrame, bucket: int = 256) -> DataFrame:
    """``findings`` with the ``uid`` of their unit (see ``map_findings``), by one join."""
    return findings.join(map_findings(findings, units, bucket).select("finding_id", "uid"), "finding_id").select(*findings.columns, "uid")


# ---------------------------------------------------------------- D6, D7
def merge_findings(f: DataFrame) -> DataFrame:
    """Per unit, merge findings on (line, cwe): best confidence (first on ties),
    +0.05 capped at 1.0 when several, sorted distinct tools joined by '+', and
    a '[a, b] ' message prefix.  Null-CWE findings pass through."""
    has_cwe = F.coalesce(F.col("cwe_id"), F.lit("")) != ""  # '' is no CWE either
    keyed = f.filter(has_cwe)
    best = F.struct(F.col("confidence"), (-F.col("finding_id")).alias("_neg"))
    cols = ["finding_id", "rule_id", "severity", "confidence", "message", "tool", "file_path", "col"]
    g = keyed.groupBy("uid", "line", "cwe_id").agg(
        F.max_by(F.struct(*cols), best).alias("b"),
        F.count(F.lit(1)).alias("n_merged"),
        F.array_sort(F.collect_set("tool")).alias("_tools"),  # <= number of tools per group
    )
    many = F.col("n_merged") > 1
    merged = g.select(
        "uid", "line", "cwe_id", F.col("b.finding_id").alias("finding_id"), F.col("b.rule_id").alias("rule_id"),
        F.col("b.severity").alias("severity"),
        F.when(many, F.least(F.col("b.confidence") + F.lit(0.05), F.lit(1.0))).otherwise(F.col("b.confidence")).alias("confidence"),
        F.when(many, F.concat(F.lit("["), F.array_join("_tools", ", "), F.lit("] "), F.col("b.message")))
        .otherwise(F.col("b.message")).alias("message"),
        F.when(many, F.array_join("_tools", "+")).otherwise(F.col("b.tool")).alias("tool"),
        F.col("b.file_path").alias("file_path"), "n_merged",
    )
    passthru = f.filter(~has_cwe).select(
        "uid", "line", "cwe_id", "finding_id", "rule_id", "severity", "confidence", "message", "tool", "file_path",
        F.lit(1).cast("long").alias("n_merged"))
    return merged.unionByName(passthru)


def distinct_cwe_types(f: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """Per unit, '{cwe}: {name}' labels in first-seen order (line, finding_id).

    Pre-aggregates to one row per (uid, label) before collecting, so each
    list holds at most the distinct labels of a unit, never its findings.
    """
    dim = dim if dim is not None else cwe_dim(f.sparkSession)
    e = f.filter(F.coalesce("cwe_id", F.lit("")) != "").join(F.broadcast(dim.select("cwe_id", "cwe_name")), "cwe_id", "left")
    lab = F.concat(F.col("cwe_id"), F.lit(": "), F.coalesce(F.col("cwe_name"), F.lit("None")))
    first = e.groupBy("uid", lab.alias("label")).agg(F.min(F.struct("line", "finding_id")).alias("_first"))
    per = first.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("_first", "label"))).alias("_l"))
    return per.select("uid", F.transform("_l", lambda x: x["label"]).alias("cwe_types"))


# ---------------------------------------------------------------- J3-J5, J13
def clean_units(units: DataFrame, f: DataFrame) -> DataFrame:
    return units.join(f.select("uid"), "uid", "left_anti")


def flagged_units(units: DataFrame, f: DataFrame) -> DataFrame:
    return units.join(f.select("uid"), "uid", "left_semi")


def enrich_findings(f: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """Left join of the fixed 30-row dimension (broadcast); defaults for unknown CWE."""
    dim = dim if dim is not None else cwe_dim(f.sparkSession)
    d = dim.select("cwe_id", F.col("cwe_name").alias("dim_name"), "dim_severity", F.col("cvss").alias("severity_score"),
                   F.col("mitigation").alias("dim_mitigation"), F.col("example_fix").alias("dim_fix"), "description")
    j = f.join(F.broadcast(d), "cwe_id", "left")
    known = F.col("dim_name").isNotNull()
    return (j.withColumn("cwe_name", F.col("dim_name"))
            .withColumn("mitigation", F.when(known, F.col("dim_mitigation")).otherwise(F.lit(UNKNOWN_CWE_MITIGATION)))
            .withColumn("recommendation", F.when(known, F.col("dim_fix")).otherwise(F.lit(UNKNOWN_CWE_RECOMMENDATION)))
            .drop("dim_name", "dim_mitigation", "dim_fix"))


def category_rollup(f: DataFrame, unknown: str = "uncategorized") -> DataFrame:
    cats = cwe_categories(f.sparkSession)
    return f.join(F.broadcast(cats), "cwe_id", "left").withColumn("category", F.coalesce("category", F.lit(unknown)))


def untracked_categories(f: DataFrame) -> DataFrame:
    """CWE ids seen in findings but absent from the dimension."""
    dim = cwe_dim(f.sparkSession).select("cwe_id")
    return f.select("cwe_id").filter(F.col("cwe_id").isNotNull()).distinct().subtract(dim)


# ---------------------------------------------------------------- J6
def resolve_report_paths(report: DataFrame, files: DataFrame, path_col: str = "path", rel_col: str = "rel_path",
                         abs_col: str | None = None) -> DataFrame:
    """Report path -> rel_path: the file whose absolute path it is (``abs_col``;
    without one, whose rel_path it is), else the smallest rel_path that ends the
    report path; unmatched rows are dropped.

    Resolution runs once per distinct report path, and the suffix step is an equi
    join on the suffixes whose length some rel_path has."""
    fl = files.select(F.col(rel_col).alias("_rel"), F.col(abs_col or rel_col).alias("_abs")).distinct()
    paths = report.select(F.col(path_col).alias("_p")).distinct()
    exact = paths.join(fl, paths["_p"] == fl["_abs"], "inner").groupBy("_p").agg(F.min("_rel").alias("_rel"))
    rest = paths.join(fl, paths["_p"] == fl["_abs"], "left_anti")
    rel = fl.select("_rel").distinct()
    lengths = rel.select(F.array_sort(F.collect_set(F.length("_rel")))).first()[0]  # a path's length: a few hundred values
    sfx = rest.withColumn("_n", F.explode(F.array(*[F.lit(n) for n in lengths or [0]]))).filter(F.col("_n") <= F.length("_p"))
    cand = sfx.join(rel, F.expr("right(_p, _n)") == rel["_rel"], "inner")
    best = cand.groupBy("_p").agg(F.min("_rel").alias("_rel"))
    resolved = exact.select("_p", "_rel").unionByName(best)
    out = report.join(resolved, report[path_col] == resolved["_p"], "inner").drop("_p")
    return out.withColumnRenamed("_rel", rel_col)


# ---------------------------------------------------------------- F7
def tool_noise_filter(report: DataFrame) -> DataFrame:
    """XML-tool rows: drop suppressed ids, non-security severities unless
    overridden, and line 0; map severity and confidence."""
    keep = (~F.col("rule_id").isin(*XML_TOOL_SUPPRESS)) & (
        ~F.col("tool_severity").isin(*XML_TOOL_SKIP_SEVERITIES) | F.col("rule_id").isin(*XML_TOOL_SECURITY_OVERRIDES)
    ) & (F.col("line") != 0)
    sev = TX.map_lookup("tool_severity", XML_TOOL_SEVERITY, "MEDIUM")
    return (report.filter(keep).withColumn("severity", sev)
            .withColumn("confidence", TX.map_lookup("severity", SEVERITY_CONFIDENCE, 0.5)))


# ---------------------------------------------------------------- A14-A23
def unit_verdict(f: DataFrame) -> DataFrame:
    return f.groupBy("uid").agg(
        F.count(F.lit(1)).alias("n_findings"),
        F.max("confidence").alias("max_confidence"),
        F.max_by("severity", F.struct(severity_rank("severity"), F.lit(0))).alias("max_severity"),
    ).withColumn("is_vulnerable", F.col("n_findings") > 0)


def static_results(units: DataFrame, f: DataFrame) -> DataFrame:
    """One row per unit (units without findings kept), flattened report row."""
    v = unit_verdict(f)
    types = distinct_cwe_types(f)
    r = units.select("uid", "function_name", "file_path", "start_line").join(v, "uid", "left").join(types, "uid", "left")
    return r.select(
        "uid", "function_name", "file_path", "start_line",
        F.coalesce("is_vulnerable", F.lit(False)).alias("is_vulnerable"),
        F.coalesce("max_confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("max_severity", F.lit("LOW")).alias("severity"),
        F.coalesce("n_findings", F.lit(0)).cast("long").alias("n_findings"),
        F.coalesce(F.array_join("cwe_types", "; "), F.lit("")).alias("cwe_types"),
    )


def static_report(units: DataFrame, f: DataFrame, snippet: int = 500) -> DataFrame:
    """One nested row per unit: code_snippet, static_vulnerable, static_confidence,
    static_findings[] in order of (line, finding_id), cwe_types[] in first-seen order.

    A unit's findings are its own row in the report, so they are collected here only."""
    nested = F.struct("line", "finding_id", "tool", "message", "severity", "cwe_id", "cwe_name")
    dim = cwe_dim(f.sparkSession).select("cwe_id", "cwe_name")
    per = f.join(F.broadcast(dim), "cwe_id", "left").groupBy("uid").agg(F.array_sort(F.collect_list(nested)).alias("_l"))
    per = per.select("uid", F.transform("_l", lambda x: F.struct(x["tool"].alias("tool"), x["message"].alias("message"), x["severity"].alias("severity"), x["cwe_id"].alias("cwe_id"), x["cwe_name"].alias("cwe_name"))).alias("static_findings"))
    r = (units.select("uid", "function_name", "file_path", F.col("start_line").alias("line_number"), TX.snippet("code", snippet).alias("code_snippet"))
         .join(unit_verdict(f).select("uid", "max_confidence", "max_severity"), "uid", "left")
         .join(per, "uid", "left").join(distinct_cwe_types(f), "uid", "left"))
    none = F.array().cast("array<struct<tool:string,message:string,severity:string,cwe_id:string,cwe_name:string>>")
    return r.select(
        "uid", "function_name", "file_path", "line_number", "code_snippet",
        F.col("static_findings").isNotNull().alias("static_vulnerable"),
        F.coalesce("max_confidence", F.lit(0.0)).alias("static_confidence"),
        F.coalesce("max_severity", F.lit("LOW")).alias("severity"),
        F.coalesce("static_findings", none).alias("static_findings"),
        F.coalesce("cwe_types", F.array().cast("array<string>")).alias("cwe_types"))


def static_summary(report: DataFrame) -> DataFrame:
    """Totals, findings per tool, and units per cwe_types entry, in long form (kind,
    key, value): one pass over the nested report."""
    total = lambda k, v: F.struct(F.lit("total").alias("kind"), F.lit(k).alias("key"), v.cast("long").alias("value"))
    hit = F.col("static_vulnerable").cast("long")
    rows = F.concat(
        F.array(total("functions", F.lit(1)), total("vulnerable", hit), total("safe", 1 - hit), total("findings", F.size("static_findings"))),
        F.transform("static_findings", lambda x: F.struct(F.lit("tool").alias("kind"), x["tool"].alias("key"), F.lit(1).cast("long").alias("value"))),
        F.transform("cwe_types", lambda x: F.struct(F.lit("cwe").alias("kind"), x.alias("key"), F.lit(1).cast("long").alias("value"))))
    return report.select(F.inline(rows)).groupBy("kind", "key").agg(F.sum("value").alias("value"))


def report_metadata(static: DataFrame, ml: DataFrame, files: DataFrame, threshold: float = 0.308, model: str = "ensemble",
                    generated_at=None) -> DataFrame:
    """One row: metadata, static_summary and ml_summary of a report (``static`` with
    static_vulnerable, ``ml`` with flagged).  The flagged lists are the two tables' own
    rows: ``flagged_rows``."""
    s = static.agg(F.count(F.lit(1)).alias("n"), F.count_if("static_vulnerable").alias("v"))
    m = ml.agg(F.count(F.lit(1)).alias("mn"), F.count_if("flagged").alias("mv"))
    n_files = files.select(F.count(F.lit(1))).scalar()
    ml_row = m.select(F.struct("mn", "mv")).scalar()  # one row
    both = s.withColumn("_m", ml_row).select("n", "v", "_m.mn", "_m.mv")
    return both.select(
        F.struct(F.coalesce(F.lit(generated_at).cast("timestamp"), F.current_timestamp()).alias("generated_at"),
                 F.lit(f"{model} + Static Analysis").alias("model_version"), F.lit(model).alias("ml_model"),
                 F.lit(threshold).alias("threshold"), n_files.alias("total_files_analyzed"),
                 F.col("n").alias("total_functions_analyzed")).alias("metadata"),
        F.struct(F.col("v").alias("total_vulnerable"), (F.col("n") - F.col("v")).alias("total_safe")).alias("static_summary"),
        F.struct(F.col("mv").alias("total_vulnerable"), (F.col("mn") - F.col("mv")).alias("total_safe")).alias("ml_summary"))


def flagged_rows(rows: DataFrame, flag: str = "static_vulnerable") -> DataFrame:
    """The flagged list of a report."""
    return rows.filter(F.col(flag))


def filter_results(res: DataFrame, flagged: bool | None = None, severities: Sequence[str] | None = None,
                   flag: str = "is_vulnerable") -> DataFrame:
    """Result filters of the report views: by verdict, by severity."""
    if flagged is not None:
        res = res.filter(F.col(flag) == F.lit(flagged))
    return res.filter(F.col("severity").isin(*severities)) if severities else res


def filter_log_level(logs: DataFrame, exclude: Sequence[str] = ("DEBUG",)) -> DataFrame:
    return logs.filter(~F.col("level").isin(*exclude))


def vulnerability_rate(res: DataFrame, flag: str = "is_vulnerable") -> DataFrame:
    n = F.count(F.lit(1))
    rate = F.when(n == 0, F.lit(0.0)).otherwise(F.count_if(flag) * 100.0 / F.when(n == 0, 1).otherwise(n))
    return res.agg(n.alias("total"), F.count_if(flag).alias("flagged"), F.round(rate, 6).alias("rate"))


def ml_summary(scored: DataFrame, score: str = "score") -> DataFrame:
    """Totals, severity counts and the mean score of flagged rows (0 if none; also to 4 digits).
    ``scored`` has flagged and severity."""
    mean = F.coalesce(F.avg(F.when(F.col("flagged"), F.col(score))), F.lit(0.0))
    return scored.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("flagged").alias("flagged"),
        *[F.count_if(F.col("severity") == lv).alias(lv.lower()) for lv in SEVERITY_ORDER],
        F.round(mean, 6).alias("avg_confidence"), F.round(mean, 4).alias("avg_confidence_4"))


def findings_by_tool(f: DataFrame) -> DataFrame:
    return f.groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


def sort_findings(f: DataFrame) -> DataFrame:
    """Position of each finding in its unit, by line."""
    return global_rank(f, ["line", "finding_id"], ["uid"], out_col="pos")


def ranked_results(res: DataFrame) -> DataFrame:
    """uid, rank: flagged first, then by falling confidence."""
    r = res.select("uid", (~F.col("is_vulnerable")).cast("int").alias("_nf"), (-F.col("confidence")).alias("_nc"))
    return global_rank(r, ["_nf", "_nc", "uid"], out_col="rank").select("uid", "rank")


def top_flagged(res: DataFrame, n: int = 20) -> DataFrame:
    return res.filter("is_vulnerable").orderBy(F.desc("confidence"), "uid").limit(n)


def least_suspicious(res: DataFrame, n: int = 5) -> DataFrame:
    return res.filter(~F.col("is_vulnerable")).orderBy("confidence", "uid").limit(n)


def severity_histogram(res: DataFrame, col: str = "severity", flag: str | None = "is_vulnerable") -> DataFrame:
    """Fixed order CRITICAL..LOW, zero-filled (left join from the 4-row order table)."""
    order = res.sparkSession.createDataFrame([(s, i) for i, s in enumerate(SEVERITY_ORDER)], f"{col} string, ord int")
    src = res.filter(F.col(flag)) if flag else res
    counts = src.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(order).join(counts, col, "left").select(col, "ord", F.coalesce("n", F.lit(0)).alias("n"))


def ml_severity(score: str = "score", flagged: str = "flagged", medium: float = 0.40):
    s = F.col(score)
    return (F.when(~F.col(flagged), F.lit("N/A")).when(s >= 0.85, "CRITICAL").when(s >= 0.65, "HIGH")
            .when(s >= medium, "MEDIUM").otherwise("LOW"))


def detector_agreement(static: DataFrame, ml: DataFrame, key: str = "uid") -> DataFrame:
    """J11 + A21: left join ML onto static results by unit key."""
    j = static.select(key, F.col("is_vulnerable").alias("s_flag"), F.col("confidence").alias("s_conf")).join(
        ml.select(key, F.col("flagged").alias("m_flag"), F.col("score").alias("m_conf")), key, "left")
    s = F.coalesce("s_flag", F.lit(False))
    m = F.coalesce("m_flag", F.lit(False))
    cat = F.when(s & m, "Both").when(m, "ML only").when(s, "Static only").otherwise("None")
    return j.select(key, cat.alias("agreement"), (s | m).alias("vulnerable"),
                    F.greatest(F.coalesce("s_conf", F.lit(0.0)), F.coalesce("m_conf", F.lit(0.0))).alias("confidence"))


def cube_report(f: DataFrame, dims: Sequence[str] = ("tool", "severity", "category")) -> DataFrame:
    return f.cube(*dims).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))


def with_severity(df: DataFrame, level_col: str, tool: str) -> DataFrame:
    """Tool level -> normalised severity for the three report vocabularies."""
    from ..sources.fixed import CSV_TOOL_LEVEL, JSON_TOOL_SEVERITY
    if tool == "xml":
        sev = TX.map_lookup(level_col, XML_TOOL_SEVERITY, "MEDIUM")
    elif tool == "csv":
        sev = TX.map_lookup(F.col(level_col).cast("int"), CSV_TOOL_LEVEL, "LOW")
    else:
        sev = TX.map_lookup(F.upper(F.col(level_col)), JSON_TOOL_SEVERITY, "LOW")
    return df.withColumn("severity", sev)


def with_confidence(df: DataFrame, default: float = 0.5) -> DataFrame:
    """Severity -> confidence."""
    return df.withColumn("confidence", TX.map_lookup("severity", SEVERITY_CONFIDENCE, default))

"""Source/sink round trips (S1, S3, K1-K4) and streaming jobs.

Each query writes data Spark derives from the driver tables into the shared
checkpoint folder, reads it back through the library reader or a stream, and
returns the result, so the readers and sinks run at table scale.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import evaluate as EV
from ..operators import rules as RU
from ..operators.helpers import ordered_scan
from ..session import shared_path
from ..sources import archives as AR
from ..sources import files as FS
from ..sources import json_ranges as JR
from ..sources.fixed import XML_TOOL_SECURITY_OVERRIDES, XML_TOOL_SKIP_SEVERITIES, XML_TOOL_SUPPRESS
from ..streaming import jobs as ST
from . import q_corpus, q_eval, q_rules
from . import views as V
from .registry import REGISTRY, register


@register("corpus_jsonl_roundtrip", "SELECT id, dataset, language, code, label_binary, label_cwe, label_cve FROM v_corpus")
def corpus_jsonl_roundtrip(spark, d):
    """K1 write canonical JSONL (all 7 keys, nulls kept) -> S1 read with declared schema."""
    path = shared_path(spark, "corpus-jsonl")
    FS.write_corpus_jsonl(V.v_corpus(spark, d), path)
    return FS.read_corpus(spark, path).drop("_corrupt_record")


@register("raw_values_roundtrip")
def raw_values_roundtrip(spark, d):
    """S3: raw records as one JSON value per line -> typed read -> normaliser."""
    path = shared_path(spark, "raw-values")
    V.v_raw_diversevul(spark, d).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    raw = FS.read_raw_json_values(spark, path, "ordinal long, func string, target int, cwe string, message string")
    return C.normalize_diversevul(raw)


# same oracle as the direct normaliser
REGISTRY["raw_values_roundtrip"] = (raw_values_roundtrip, REGISTRY["normalize_diversevul"][1])


@register("splits_roundtrip", q_corpus.SPLIT_SQL + "SELECT split, count(*) AS n FROM s GROUP BY split")
def splits_roundtrip(spark, d):
    """K2: one dataset per split (partitionBy) -> partition-pruned reads."""
    path = shared_path(spark, "splits")
    FS.write_splits(q_corpus._split(spark, d), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("metrics_roundtrip", f"SELECT threshold, tp, fp, fn, tn FROM ({q_eval.SWEEP_SQL}) x")
def metrics_roundtrip(spark, d):
    """K4: sweep rows written as JSON metrics and read back."""
    path = shared_path(spark, "metrics")
    FS.write_metrics(EV.threshold_sweep(V.v_scored(spark, d)).select("threshold", "tp", "fp", "fn", "tn"), path)
    return spark.read.schema("threshold double, tp long, fp long, fn long, tn long").json(path)


@register("report_roundtrip", "SELECT count(*) AS n, count_if(is_vulnerable) AS flagged, CAST(sum(n_findings) AS BIGINT) AS findings FROM v_results")
def report_roundtrip(spark, d):
    """K3: the nested report written as JSON -> read back -> counts."""
    from . import q_findings
    from ..operators import findings as FD
    path = shared_path(spark, "report")
    report = FD.static_report(*q_findings._merged(spark, d))
    FS.write_report(report, path)
    r = spark.read.schema(report.schema).json(path)
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if("static_vulnerable").alias("flagged"),
                 F.sum(F.size("static_findings")).cast("long").alias("findings"))


# ------------------------------------------------------------------ readers over files derived from the tables
_EV_SQL = """SELECT event_id, 'src' || CAST(user_id % 20 AS VARCHAR) AS file, CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id % 500 + 1 END AS line,
  CAST(event_id % 80 AS INTEGER) AS col, CAST(event_id % 6 AS INTEGER) AS level, event_type FROM events"""
_LEVELS = ["error", "warning", "style", "performance", "portability", "information"]
_RULES = ["nullPointer", "missingInclude", "uninitvar", "unusedVariable", "memleak", "checkersReport", "zerodiv"]


def _report_events(spark, d):
    return V.table(spark, d, "events").select(
        "event_id", F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("file"),
        F.when(F.col("event_id") % 11 == 0, F.lit(0)).otherwise(F.col("event_id") % 500 + 1).alias("line"),
        (F.col("event_id") % 80).cast("int").alias("col"), (F.col("event_id") % 6).cast("int").alias("level"), "event_type")


def _pick(names, i):
    return F.get(F.array(*[F.lit(x) for x in names]), (i % len(names)).cast("int"))


def _pick_sql(names, i):
    return "[" + ", ".join(f"'{x}'" for x in names) + f"][{i} % {len(names)} + 1]"


@register("xml_report_roundtrip", f"""
WITH e AS ({_EV_SQL}), r AS (SELECT *, {_pick_sql(_RULES, 'event_id')} AS rule_id, {_pick_sql(_LEVELS, 'level')} AS tool_severity FROM e)
SELECT 'cppcheck' AS tool, rule_id, CASE WHEN event_id % 3 > 0 THEN 'CWE-' || (event_id % 700) END AS cwe_id,
       CASE WHEN tool_severity = 'error' THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       CASE WHEN tool_severity = 'error' THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence,
       'finding ' || event_id AS message, file AS file_path, line, CASE WHEN event_id % 5 > 0 THEN col END AS col
FROM r WHERE rule_id NOT IN ({', '.join(f"'{x}'" for x in XML_TOOL_SUPPRESS)}) AND line <> 0
  AND (tool_severity NOT IN ({', '.join(f"'{x}'" for x in XML_TOOL_SKIP_SEVERITIES)}) OR rule_id IN ({', '.join(f"'{x}'" for x in XML_TOOL_SECURITY_OVERRIDES)}))""")
def xml_report_roundtrip(spark, d):
    """Events written as an XML tool report -> findings."""
    path = shared_path(spark, "report-xml")
    e = _report_events(spark, d)
    loc = F.struct(F.col("file").alias("_file"), F.col("line").alias("_line"), F.when(F.col("event_id") % 5 > 0, F.col("col")).alias("_column"))
    x = e.select(_pick(_RULES, F.col("event_id")).alias("_id"), _pick(_LEVELS, F.col("level")).alias("_severity"),
                 F.lit("short").alias("_msg"), F.concat(F.lit("finding "), F.col("event_id").cast("string")).alias("_verbose"),
                 F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 700).alias("_cwe"), F.array(loc).alias("location"))
    x.write.format("xml").option("rootTag", "results").option("rowTag", "error").save(path)
    return FS.read_findings_xml(spark, path).drop("cwe_name", "highlighted_code")


@register("csv_report_roundtrip", f"""
WITH e AS ({_EV_SQL})
SELECT 'flawfinder' AS tool, 'flawfinder:' || event_type AS rule_id,
       CASE event_id % 3 WHEN 0 THEN 'CWE-' || (event_id % 700) WHEN 1 THEN 'CWE-' || (event_id % 300) END AS cwe_id,
       CASE level WHEN 5 THEN 'CRITICAL' WHEN 4 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       CASE level WHEN 5 THEN 0.95 WHEN 4 THEN 0.85 WHEN 3 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence,
       CASE WHEN event_id % 3 = 0 THEN 'copy, "unsafe"' || chr(10) || '(CWE-' || (event_id % 700) || ')' ELSE event_type || ':   f(x);' END AS message,
       file AS file_path, line, nullif(col, 0) AS col, 'f(x);' AS highlighted_code
FROM e WHERE line <> 0""")
def csv_report_roundtrip(spark, d):
    """Events written as a CSV tool report (file_path from its File column) -> findings."""
    path = shared_path(spark, "report-csv")
    i, n = F.col("event_id") % 3, F.col("event_id").cast("string")
    warning = F.concat(F.lit('copy, "unsafe"\n(CWE-'), (F.col("event_id") % 700).cast("string"), F.lit(")"))
    url = F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), (F.col("event_id") % 300).cast("string"), F.lit(".html"))
    c = _report_events(spark, d).select(
        F.col("file").alias("File"), F.col("line").alias("Line"), F.col("col").alias("Column"), F.col("level").alias("Level"),
        F.col("event_type").alias("Name"), F.when(i == 0, warning).alias("Warning"), F.lit("  f(x);").alias("Context"),
        F.when(i == 1, url).alias("URL"), n.alias("Fingerprint"))
    c.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return FS.read_findings_csv(spark, path).drop("cwe_name")


def _write_objects(spark, rows, bucket, what, name):
    """One JSON object per file: ``what`` of about a thousand rows each."""
    root = shared_path(spark, name)
    files = rows.groupBy(F.concat(F.lit("part-"), bucket.cast("string"), F.lit(".json")).alias("path")).agg(what.alias("content"))
    FS.write_files(files, root)
    return root


@register("json_report_roundtrip", f"""
WITH e AS ({_EV_SQL})
SELECT 'semgrep' AS tool, 'rule-' || level AS rule_id, CASE WHEN event_id % 2 = 0 THEN 'CWE-' || (event_id % 700) END AS cwe_id,
       CASE WHEN level = 0 THEN 'HIGH' WHEN level = 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       CASE WHEN level = 0 THEN 0.85 WHEN level = 1 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence,
       'finding ' || event_id AS message, file AS file_path, line, col, 'f(x);' AS highlighted_code
FROM e WHERE line <> 0""")
def json_report_roundtrip(spark, d):
    """Events written as JSON tool reports of about a thousand results -> findings."""
    lists = F.when(F.col("event_id") % 2 == 0, F.array(F.concat(F.lit("CWE-"), (F.col("event_id") % 700).cast("string"), F.lit(": x"))))
    level = F.when(F.col("level") == 0, "error").when(F.col("level") == 1, "WARNING").when(F.col("level") == 2, "INFO")
    extra = F.struct(level.alias("severity"), F.concat(F.lit("finding "), F.col("event_id").cast("string")).alias("message"),
                     F.lit("  f(x);").alias("lines"), F.struct(lists.alias("cwe")).alias("metadata"))
    one = F.struct(F.col("file").alias("path"), F.concat(F.lit("rule-"), F.col("level").cast("string")).alias("check_id"),
                   F.struct("line", "col").alias("start"), extra.alias("extra"))
    root = _write_objects(spark, _report_events(spark, d), F.floor(F.col("event_id") / 1000),
                          F.to_json(F.struct(F.collect_list(one).alias("results"))), "report-json")
    return FS.read_findings_json(spark, root).drop("cwe_name")


@register("predictions_roundtrip", "SELECT CAST(score >= 0.5 AS INTEGER) AS prediction, score, label FROM v_scored")
def predictions_roundtrip(spark, d):
    """Scored rows written as runs of predictions, probabilities and labels -> one row per example."""
    s = V.v_scored(spark, d).select("doc_id", F.struct((F.col("score") >= 0.5).cast("int").alias("p"), "score", "label").alias("r"))
    run = F.collect_list("r")
    what = F.to_json(F.struct(run["p"].alias("predictions"), run["score"].alias("probabilities"), run["label"].alias("labels")))
    return FS.read_predictions(spark, _write_objects(spark, s, F.floor(F.col("doc_id") / 1000), what, "predictions"))


@register("json_array_roundtrip")
def json_array_roundtrip(spark, d):
    """Raw records written as JSON arrays -> typed read -> normaliser."""
    raw = V.v_raw_devign(spark, d)
    what = F.to_json(F.collect_list(F.struct(*raw.columns)))
    root = _write_objects(spark, raw, F.floor(F.col("ordinal") / 1000), what, "raw-array")
    return C.normalize_devign(FS.read_raw_json_array(spark, root, "ordinal long, func string, target int, commit_id string"))


REGISTRY["json_array_roundtrip"] = (json_array_roundtrip, REGISTRY["normalize_devign"][1])


def _one_line(spark, rows, name, array):
    """Rows as JSON files of a single line each: an array, or objects with a blank between."""

    def run(batches):
        first = True
        for batch in JR.slices(batches, 0):
            text = batch.column(0).to_pylist()
            if array:
                text = [("[" if first and not i else ",") + v for i, v in enumerate(text)]
            first = first and not text
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string())], ["value"])
        if array:
            yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], ["value"])

    root = shared_path(spark, name)
    rows.select(F.to_json(F.struct(*rows.columns))).mapInArrow(run, "value string").write.option("lineSep", " ").text(root)
    return root


@register("json_array_one_line")
def json_array_one_line(spark, d):
    """Raw records as arrays on one line, read by byte ranges -> normaliser."""
    root = _one_line(spark, V.v_raw_devign(spark, d), "array-line", True)
    return C.normalize_devign(FS.read_raw_json_array(spark, root, "ordinal long, func string, target int, commit_id string"))


REGISTRY["json_array_one_line"] = (json_array_one_line, REGISTRY["normalize_devign"][1])


@register("raw_values_positions", """
SELECT ordinal, length(func) AS chars, target, true AS in_order FROM v_raw_diversevul""")
def raw_values_positions(spark, d):
    """S3: raw records without a line break, read by byte ranges with their offsets; the order of
    the offsets in each file is that in which the records were written (ordinal, here sorted)."""
    root = _one_line(spark, V.v_raw_diversevul(spark, d).sortWithinPartitions("ordinal"), "values-line", False)
    raw = FS.read_raw_json_values(spark, root, "ordinal long, func string, target int", position=True)
    ranked = ordered_scan(raw.select("_file", "_offset", "ordinal"), ["_offset"], None, ["_file"], "by_offset")
    ranked = ordered_scan(ranked.select("_file", "ordinal", "by_offset"), ["ordinal"], None, ["_file"], "by_ordinal")
    same = ranked.select("ordinal", (F.col("by_offset") == F.col("by_ordinal")).alias("in_order"))
    return raw.join(same, "ordinal").select("ordinal", F.length("func").alias("chars"), "target", "in_order")


def _tree(spark, d):
    root = shared_path(spark, "tree")
    FS.write_files(V.v_labelled_files(spark, d).select("path", "content"), root)
    return root


@register("labelled_tree_roundtrip")
def labelled_tree_roundtrip(spark, d):
    """Pages written as a labelled source tree -> label and category from the path -> normaliser."""
    return C.normalize_labelled(FS.read_labelled_files(spark, _tree(spark, d)))


REGISTRY["labelled_tree_roundtrip"] = (labelled_tree_roundtrip, REGISTRY["normalize_labelled"][1])


@register("source_tree_roundtrip", """
SELECT path AS rel_path, CASE WHEN ends_with(path, '.cpp') THEN 'cpp' ELSE 'c' END AS language,
       CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS digest FROM v_labelled_files WHERE strlen(content) <= 1048576""")
def source_tree_roundtrip(spark, d):
    """Pages written as a source tree -> accepted files with relative path, language and text."""
    f = FS.read_accepted_files(spark, _tree(spark, d))
    return f.select("rel_path", "language", "size", F.sha2("content", 256).alias("digest"))


# ------------------------------------------------------------------ archives
_REGULAR, _LINK = 0o100644, 0o120777


@register("archive_members", """
SELECT 'a' || (doc_id // 100) || '.zip' AS archive, 'docs/' || doc_id || '.txt' AS member, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size,
       sha256(coalesce(text, '')) AS digest FROM documents""")
def archive_members(spark, d):
    """Documents packed a hundred to an archive, every tenth also under an unsafe name -> safe members."""
    root = shared_path(spark, "archives")
    docs = V.table(spark, d, "documents").select(F.concat(F.lit("a"), F.floor(F.col("doc_id") / 100).cast("string"), F.lit(".zip")).alias("archive"), "doc_id", F.coalesce("text", F.lit("")).alias("content"), F.lit(_REGULAR).alias("mode"))
    name = F.col("doc_id").cast("string")
    safe = docs.withColumn("member", F.concat(F.lit("docs/"), name, F.lit(".txt")))
    unsafe = docs.filter("doc_id % 10 = 0").withColumn("member", F.concat(F.when(F.col("doc_id") % 20 == 0, F.lit("../")).otherwise(F.lit("/")), name))
    AR.write_archives(safe.unionByName(unsafe), root)
    m = AR.read_source_archives(spark, f"{root}/*.zip")
    return m.select(F.substring_index("archive", "/", -1).alias("archive"), "member", "size", F.sha2("content", 256).alias("digest"))


def _packed_sources(spark, d):
    """The generated sources, a hundred to an archive: some in folders that are left out, some links, some no sources."""
    root = shared_path(spark, "source-archives")
    i = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    folder = F.when(i % 7 == 0, F.lit("build/")).when(i % 11 == 0, F.lit("src/.cache/")).otherwise(F.lit("src/"))
    name = F.regexp_replace("path", r"\.c$", "")
    rows = q_rules.generated_sources(spark, d).select(
        F.concat(F.lit("s"), F.floor(i / 100).cast("string"), F.lit(".zip")).alias("archive"),
        F.concat(folder, name, F.when(i % 5 == 0, F.lit(".txt")).when(i % 5 == 1, F.lit(".CPP")).otherwise(F.lit(".c"))).alias("member"),
        "content", F.when(i % 13 == 0, F.lit(_LINK)).otherwise(F.lit(_REGULAR)).alias("mode"))
    AR.write_archives(rows, root)
    return f"{root}/*.zip"


_PACKED_SQL = """s AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'build/' WHEN doc_id % 11 = 0 THEN 'src/.cache/' ELSE 'src/' END || 'gen/' || doc_id
  || CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.CPP' ELSE '.c' END AS rel_path, doc_id % 13 = 0 AS link
  FROM documents WHERE doc_id % 7 > 0 AND doc_id % 11 > 0 AND doc_id % 5 > 0)"""


@register("archive_functions", "WITH f AS (" + q_rules.DECLARATORS_SQL + "), " + _PACKED_SQL + """
SELECT 's' || (doc_id // 100) || '.zip' AS archive, rel_path, rel_path || '::' || function_name || '::' || start_line AS uid, function_name, start_line, end_line,
       CASE doc_id % 5 WHEN 1 THEN 'cpp' ELSE 'c' END AS language
FROM s JOIN f ON f.file_path = 'gen/' || doc_id || '.c' WHERE NOT link""")
def archive_functions(spark, d):
    """S5 -> F6 -> U2: packed sources -> accepted files -> functions."""
    _, functions, _ = AR.ingest_archives(spark, _packed_sources(spark, d))
    return functions.drop("code").withColumn("archive", F.substring_index("archive", "/", -1))


@register("archive_skipped", "WITH " + _PACKED_SQL + "SELECT rel_path AS path, 'symlink' AS reason FROM s WHERE link")
def archive_skipped(spark, d):
    """F6 inside archives: what the ingestion leaves out and reports."""
    return AR.ingest_archives(spark, _packed_sources(spark, d))[2].drop("archive")


# ------------------------------------------------------------------ streaming
UNIT_SCHEMA = "uid string, file_path string, start_line long, code string"


@register("stream_scan")
def stream_scan(spark, d):
    """Code units landing as files -> rule scan stream -> findings (equals batch scan_rules)."""
    src = shared_path(spark, "units-in")
    q_rules.code_units(spark, d).write.mode("overwrite").parquet(src)
    return ST.stream_scan(spark, src, UNIT_SCHEMA)


@register("stream_scan_re2", q_rules.scan_sql(RU.live_c_rules(re2_only=True)))
def stream_scan_re2(spark, d):
    """T1 over the RE2-compatible rules: the stream's rows are the batch's."""
    src = shared_path(spark, "units-in")
    q_rules.code_units(spark, d).write.mode("overwrite").parquet(src)
    return ST.stream_scan(spark, src, UNIT_SCHEMA, RU.live_c_rules(re2_only=True))


@register("stream_verdicts")
def stream_verdicts(spark, d):
    """T1 with the unit verdict over all live rules, per micro-batch."""
    src = shared_path(spark, "units-in")
    q_rules.code_units(spark, d).write.mode("overwrite").parquet(src)
    return ST.stream_verdicts(spark, src, UNIT_SCHEMA, RU.live_c_rules())


@register("stream_verdicts_re2", """SELECT uid, count(*) AS n_findings, max(confidence) AS max_confidence,
  arg_max(severity, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END) AS max_severity,
  TRUE AS is_vulnerable FROM (""" + q_rules.scan_sql(RU.live_c_rules(re2_only=True)) + ") h GROUP BY uid")
def stream_verdicts_re2(spark, d):
    """T1 with the unit verdict over the RE2-compatible rules."""
    src = shared_path(spark, "units-in")
    q_rules.code_units(spark, d).write.mode("overwrite").parquet(src)
    return ST.stream_verdicts(spark, src, UNIT_SCHEMA, RU.live_c_rules(re2_only=True))


def _arrive(df, src, parts, of):
    """The rows of the given parts as one more file each (arrival), in a folder that a stream reads."""
    for p in parts:
        df.filter(F.col("part") == p).drop("part").coalesce(of).write.mode("append").parquet(src)


@register("stream_unit_verdicts", "SELECT uid, n_findings, max_confidence, max_severity, is_vulnerable FROM v_verdict")
def stream_unit_verdicts(spark, d):
    """T1 stateful: findings of a unit spread over four arrivals 20 minutes apart, the job stopped
    and started between the second and the third; the last revisions equal the batch verdicts."""
    from . import q_findings
    src, at = shared_path(spark, "findings-in"), shared_path(spark, "verdict-job")
    f = q_findings._merged(spark, d)[1].select("uid", "severity", "confidence", F.pmod(F.xxhash64("uid", "line", "cwe_id", "message"), F.lit(4)).alias("part"))
    f = f.withColumn("event_time", F.timestamp_seconds(F.col("part") * 1200 + 1_000_000))
    settled = shared_path(spark, "findings-parts")
    f.write.parquet(settled)
    f = spark.read.parquet(settled)
    schema = "uid string, severity string, confidence double, event_time timestamp"
    _arrive(f, src, (0, 1), 4)
    ST.stream_unit_verdicts(spark, src, schema, at=at)
    _arrive(f, src, (2, 3), 4)
    # time goes on: an entry of no unit lets the watermark pass the last findings
    spark.sql("SELECT '' AS uid, 'LOW' AS severity, 0.0D AS confidence, timestamp_seconds(9000000) AS event_time").write.mode("append").parquet(src)
    return ST.last_verdicts(ST.stream_unit_verdicts(spark, src, schema, at=at)).filter("uid <> ''")


@register("stream_log_offsets", """
WITH r AS (SELECT job_id, entry_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, entry_id) AS "offset", count(*) OVER (PARTITION BY job_id) AS total FROM v_logs)
SELECT * FROM r WHERE "offset" > 5""")
def stream_log_offsets(spark, d):
    """T4 stateful: log entries arriving in three parts by time, with a restart; offsets equal the batch's."""
    src, at = shared_path(spark, "logs-in"), shared_path(spark, "offsets-job")
    logs = V.v_logs(spark, d)
    lo, hi = logs.select(F.percentile_approx(F.unix_millis(F.col("ts").cast("timestamp")), [0.33, 0.66])).first()[0]
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    logs = logs.withColumn("part", F.when(t <= lo, 0).when(t <= hi, 1).otherwise(2))
    schema = "entry_id long, job_id long, ts timestamp, level string, msg string"
    for part in range(3):
        _arrive(logs, src, (part,), 4)
        out = ST.stream_log_offsets(spark, src, schema, at=at)
    return ST.offsets_tail(out, 5)


@register("stream_dedup_exact", f"SELECT DISTINCT {q_corpus.WS_HASH_SQL.format(c='code')} AS hash FROM v_corpus")
def stream_dedup_exact(spark, d):
    """T2 exact: the corpus twice, in two runs of one job, years apart; every content passes once."""
    src, at = shared_path(spark, "corpus-in"), shared_path(spark, "dedup-job")
    c = V.v_corpus(spark, d).select("id", "code", (F.col("ordinal") * 7919 % 1000).alias("o"))
    schema = "id string, code string, event_time timestamp"
    for year in (0, 40):
        rows = c.withColumn("event_time", F.timestamp_seconds(F.col("o") * 60 + year * 31_536_000)).drop("o")
        rows.write.mode("append").parquet(src)
        out = ST.stream_dedup_exact(spark, src, schema, at=at)
    return out.select("hash")


@register("stream_dedup_hashes", f"SELECT DISTINCT {q_corpus.WS_HASH_SQL.format(c='code')} AS hash FROM v_corpus")
def stream_dedup_hashes(spark, d):
    """T2 with a delay that covers the whole span: every content once."""
    src = shared_path(spark, "corpus-in")
    V.v_corpus(spark, d).select("id", "code", F.timestamp_seconds(F.col("ordinal") * 60 + 60).alias("event_time")).write.parquet(src)
    return ST.stream_dedup(spark, src, "id string, code string, event_time timestamp", "36500 days").select("hash")


@register("stream_dedup")
def stream_dedup(spark, d):
    """Content dedup within a watermark on arriving corpus records."""
    src = shared_path(spark, "corpus-in")
    c = V.v_corpus(spark, d).select("id", "code", "ordinal",
                                    F.timestamp_seconds(F.col("ordinal") * 60).alias("event_time"))
    c.write.mode("overwrite").parquet(src)
    return ST.stream_dedup(spark, src, "id string, code string, ordinal long, event_time timestamp", "1 hour")


@register("log_rollup", """
SELECT CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS window_start, level, count(*) AS n FROM v_logs GROUP BY 1, 2""")
def log_rollup(spark, d):
    """T3 batch twin: 10-minute tumbling windows per level."""
    r = ST.log_rollup(V.v_logs(spark, d), "10 minutes")
    return r.select(F.unix_timestamp(F.col("w.start")).alias("window_start"), "level", "n")


@register("stream_log_rollup", """
SELECT CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS window_start, level, count(*) AS n FROM v_logs
WHERE (floor(epoch(ts) / 600) * 600 + 600) * 1000 <= (SELECT epoch_ms(max(ts)) FROM v_logs) - 3600000 GROUP BY 1, 2""")
def stream_log_rollup(spark, d):
    """T3 as a stream in append mode: the windows that the watermark (one hour) has closed."""
    src = shared_path(spark, "logs-in")
    V.v_logs(spark, d).write.mode("overwrite").parquet(src)
    return ST.stream_log_rollup(spark, src, "entry_id long, job_id long, ts timestamp, level string, msg string")


@register("log_tail", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, entry_id) AS "offset",
                  count(*) OVER (PARTITION BY job_id) AS total FROM v_logs)
SELECT job_id, entry_id, level, "offset", total FROM r WHERE "offset" > 5""")
def log_tail(spark, d):
    """T4: entries after offset 5 per job, with the job total."""
    return ST.log_tail(V.v_logs(spark, d), 5).select("job_id", "entry_id", "level", "offset", "total")


# ------------------------------------------------------------------ unions
@register("merge_corpora")
def merge_corpora(spark, d):
    """The four normalised datasets in one canonical corpus; counts per dataset and label."""
    m = C.merge_corpora(C.normalize_zenodo(V.v_raw_zenodo(spark, d)), C.normalize_devign(V.v_raw_devign(spark, d)),
                        C.normalize_diversevul(V.v_raw_diversevul(spark, d)), C.normalize_megavul(V.v_raw_megavul(spark, d)))
    return m.groupBy("dataset", "label_binary").agg(F.count(F.lit(1)).alias("n"))


REGISTRY["merge_corpora"] = (merge_corpora, "SELECT dataset, label_binary, count(*) AS n FROM ("
                             + " UNION ALL ".join(f"({REGISTRY[k][1]})" for k in (
                                 "normalize_zenodo", "normalize_devign", "normalize_diversevul", "normalize_megavul"))
                             + ") u GROUP BY dataset, label_binary")


@register("union_findings")
def union_findings(spark, d):
    """Findings of every source (tool reports and all live rules) in one table; counts per tool and CWE."""
    return _union(spark, d, RU.live_c_rules())


@register("union_findings_re2")
def union_findings_re2(spark, d):
    """D5 with the RE2-compatible rules."""
    return _union(spark, d, RU.live_c_rules(re2_only=True))


def _union(spark, d, rules):
    from . import q_findings
    tools = q_findings._findings(spark, d).select("tool", "cwe_id")
    scan = RU.scan_rules(q_rules.code_units(spark, d), rules).select("tool", "cwe_id")
    return tools.unionByName(scan).groupBy("tool", "cwe_id").agg(F.count(F.lit(1)).alias("n"))


REGISTRY["union_findings_re2"] = (union_findings_re2, "SELECT tool, cwe_id, count(*) AS n FROM ("
                                  f"(SELECT tool, cwe_id FROM ({REGISTRY['enrich_findings'][1].replace('SELECT f.finding_id, f.cwe_id,', 'SELECT f.tool, f.cwe_id, f.finding_id,', 1)}) a) "
                                  f"UNION ALL (SELECT tool, cwe_id FROM ({REGISTRY['scan_rules_re2'][1]}) b)) u GROUP BY tool, cwe_id")

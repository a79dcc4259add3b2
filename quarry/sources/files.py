"""File readers (S1-S9, S13) and sinks (K1-K4).

Readers declare schemas (no inference) and return DataFrames; tool-report
readers normalise to the findings schema.  JSON values are read by byte ranges
(``json_ranges``); XML and JSON tool reports are not splittable.
"""

from __future__ import annotations

import os
import posixpath
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..operators.helpers import settle
from .archives import read_source_archives  # noqa: F401 (S5)
from .json_ranges import read_json
from .fixed import CSV_TOOL_LEVEL, INGEST_EXTENSIONS, JSON_TOOL_SEVERITY, MAX_FILE_SIZE, SEVERITY_CONFIDENCE, SKIP_DIRS, XML_TOOL_SECURITY_OVERRIDES, XML_TOOL_SEVERITY, \
    XML_TOOL_SKIP_SEVERITIES, XML_TOOL_SUPPRESS

CORPUS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("dataset", T.StringType()),
    T.StructField("language", T.StringType()), T.StructField("code", T.StringType()),
    T.StructField("label_binary", T.IntegerType()), T.StructField("label_cwe", T.StringType()),
    T.StructField("label_cve", T.StringType()), T.StructField("_corrupt_record", T.StringType()),
])
FINDING_COLS = ["tool", "rule_id", "cwe_id", "cwe_name", "severity", "confidence", "message", "file_path", "line",
                "col", "highlighted_code"]


# ------------------------------------------------------------------ corpus and raw datasets
def read_corpus(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Canonical JSONL; malformed lines land in _corrupt_record (PERMISSIVE)."""
    df = spark.read.schema(CORPUS_SCHEMA).option("mode", "PERMISSIVE").json(path)
    return df.limit(limit) if limit else df


def read_raw_json_array(spark: SparkSession, path: str, schema: T.StructType | str, position: bool = False) -> DataFrame:
    """Files that are JSON arrays of objects (or one object), read by byte ranges however
    they are broken into lines; ``position`` adds ``_file`` and ``_offset``."""
    return read_json(spark, path, schema, array=True, position=position)


def read_raw_json_values(spark: SparkSession, path: str, schema: T.StructType | str, position: bool = False) -> DataFrame:
    """Concatenated JSON values (several on a line, or one over several lines), read by byte
    ranges; values that are not objects are skipped; ``position`` as above."""
    return read_json(spark, path, schema, position=position)


def list_source_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file under ``root``: abs_path, rel_path, size.  The listing has no content, so
    files that a rule on path or size leaves out are never read."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    rel = F.substring_index(F.col("path"), f"{base}/", -1)
    return b.select(F.col("path").alias("abs_path"), rel.alias("rel_path"), F.col("length").alias("size"))


_STATUS = "rel_path string, kind string, size long, readable boolean"


def list_file_status(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, kind ('file' or 'link'), size, readable of every file under ``root``, a folder
    that the tasks have mounted.  Folders that the ingestion never enters (``SKIP_DIRS``, hidden
    ones) and links to folders are not followed.  The tree is walked level by level: the folders
    of a level are dealt out over the tasks, so no task lists more than its share."""
    base = "/" + root.split("://")[-1].removeprefix("file:").strip("/")

    def scan(batches):
        kinds = pa.schema([("rel_path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("readable", pa.bool_())])
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = []
                with os.scandir(f"{base}/{folder}") as entries:
                    for e in entries:
                        link = e.is_symlink()
                        if e.is_dir(follow_symlinks=True):
                            if not link and e.name not in SKIP_DIRS and not e.name.startswith("."):
                                rows.append((f"{folder}{e.name}/", "folder", 0, True))
                        else:
                            size = 0 if link and not os.path.exists(e.path) else e.stat().st_size
                            rows.append((folder + e.name, "link" if link else "file", size, os.access(e.path, os.R_OK)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k.type) for i, k in enumerate(kinds)], schema=kinds)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, found = spark.createDataFrame([("",)], "rel_path string"), []
    while not level.isEmpty():
        rows = settle(level.repartition(n, "rel_path").mapInArrow(scan, _STATUS), "listing")
        found.append(rows.filter("kind <> 'folder'"))
        level = rows.filter("kind = 'folder'").select("rel_path")
    return reduce(DataFrame.unionByName, found)


def source_tree_status(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """F6 with file status: accepted files (rel_path, language, size), and the source files left
    out (path, reason: 'symlink', 'too large (n bytes)', 'binary / unreadable'), first rule first."""
    from ..operators.corpus import SILENT_REASONS, source_file_reason
    rule = source_file_reason("rel_path")
    reason = (F.when(rule.isin(*SILENT_REASONS), rule).when(F.col("kind") == "link", F.lit("symlink"))
              .otherwise(F.coalesce(rule, F.when(~F.col("readable"), F.lit("binary / unreadable")))))
    marked = list_file_status(spark, root).withColumn("reason", reason)
    language = F.coalesce(TX.map_lookup(TX.extension("rel_path"), INGEST_EXTENSIONS), F.lit("c"))
    accepted = marked.filter(F.col("reason").isNull()).select("rel_path", language.alias("language"), "size")
    return accepted, marked.filter(F.col("reason").isNotNull() & ~F.col("reason").isin(*SILENT_REASONS)).select(F.col("rel_path").alias("path"), "reason")


def read_accepted_files(spark: SparkSession, root: str) -> DataFrame:
    """Source files as the ingestion takes them: abs_path, rel_path, language, size, content."""
    from ..operators.corpus import accepted_files
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") <= MAX_FILE_SIZE)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    f = b.select(F.col("path").alias("abs_path"), F.substring_index(F.col("path"), f"{base}/", -1).alias("rel_path"),
                 F.col("length").alias("size"), as_text(F.col("content")).alias("content"))
    return accepted_files(f).select("abs_path", "rel_path", "language", "size", "content")


def as_text(content):
    """UTF-8, else ISO-8859-1."""
    as_text = content.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(content, "ISO-8859-1"))


def read_source_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Recursive source files: path, size, content (UTF-8, else ISO-8859-1)."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return b.select(F.col("path").alias("abs_path"), F.col("length").alias("size"), as_text(F.col("content")).alias("content"))


# ------------------------------------------------------------------ tool reports
XML_REPORT_SCHEMA = (
    "_id string, _severity string, _msg string, _verbose string, _cwe string, "
    "location array<struct<_file:string, _line:string, _column:string>>"
)


def read_findings_xml(spark: SparkSession, path: str, file_path: str | None = None) -> DataFrame:
    """<error id severity msg verbose cwe><location file line column/>*</error>: first
    location wins.  The schema is declared, so any attribute may be absent."""
    x = spark.read.format("xml").option("rowTag", "error").schema(XML_REPORT_SCHEMA).load(path)
    loc = F.get("location", 0)
    df = x.select(
        F.col("_id").alias("rule_id"), F.coalesce("_severity", F.lit("information")).alias("tool_severity"),
        F.coalesce("_verbose", "_msg", F.lit("")).alias("message"), F.col("_cwe").alias("cwe"),
        F.coalesce(loc["_line"].try_cast("long"), F.lit(0)).alias("line"), loc["_column"].try_cast("int").alias("col"),
        loc["_file"].alias("file_path"))
    keep = (~F.col("rule_id").isin(*XML_TOOL_SUPPRESS)) & (
        ~F.col("tool_severity").isin(*XML_TOOL_SKIP_SEVERITIES) | F.col("rule_id").isin(*XML_TOOL_SECURITY_OVERRIDES)
    ) & (F.col("line") != 0)
    sev = TX.map_lookup("tool_severity", XML_TOOL_SEVERITY, "MEDIUM")
    return df.filter(keep).select(
        F.lit("cppcheck").alias("tool"), "rule_id",
        F.when(F.col("cwe").isNotNull() & (F.col("cwe") != ""), F.concat(F.lit("CWE-"), F.col("cwe"))).alias("cwe_id"),
        F.lit(None).cast("string").alias("cwe_name"), sev.alias("severity"),
        TX.map_lookup(sev, SEVERITY_CONFIDENCE, 0.5).alias("confidence"), "message",
        F.coalesce("file_path", F.lit(file_path)).alias("file_path"), "line", "col",
        F.lit(None).cast("string").alias("highlighted_code"))


def read_findings_csv(spark: SparkSession, path: str, file_path: str | None = None) -> DataFrame:
    """CSV report with header; CWE from Warning/Category/Note/URL/CWEs, else URL definitions/<n>."""
    c = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    for k in ("File", "Line", "Column", "Level", "DefaultLevel", "Category", "Name", "Warning", "Note", "CWEs", "Context", "URL"):
        if k not in c.columns:  # tool versions differ in their column set
            c = c.withColumn(k, F.lit(None).cast("string"))
    searchable = F.concat_ws(" ", *[F.coalesce(F.col(k), F.lit("")) for k in ("Warning", "Category", "Note", "URL", "CWEs")])
    n1 = F.regexp_extract(searchable, r"CWE-(\d+)", 1)
    n2 = F.regexp_extract(searchable, r"definitions/(\d+)", 1)
    num = F.when(n1 != "", n1).when(n2 != "", n2)
    line = F.col("Line").try_cast("long")
    level = F.coalesce(F.expr("try_cast(Level AS INT)"), F.expr("try_cast(DefaultLevel AS INT)"), F.lit(0))
    sev = TX.map_lookup(level, CSV_TOOL_LEVEL, "LOW")
    ctx = F.col("Context")
    return c.filter(line.isNotNull() & (line != 0)).select(
        F.lit("flawfinder").alias("tool"), F.concat(F.lit("flawfinder:"), F.coalesce("Name", F.lit(""))).alias("rule_id"),
        F.when(num.isNotNull(), F.concat(F.lit("CWE-"), num)).alias("cwe_id"), F.lit(None).cast("string").alias("cwe_name"),
        sev.alias("severity"), TX.map_lookup(sev, SEVERITY_CONFIDENCE, 0.5).alias("confidence"),
        F.when(F.coalesce(F.col("Warning"), F.lit("")) != "", F.col("Warning"))
        .otherwise(F.concat(F.coalesce("Name", F.lit("")), F.lit(": "), F.coalesce(ctx, F.lit("")))).alias("message"),
        F.coalesce(F.nullif("File", F.lit("")), F.lit(file_path)).alias("file_path"), line.alias("line"),
        F.nullif(F.expr("try_cast(Column AS INT)"), F.lit(0)).alias("col"),
        F.when(ctx.isNotNull() & (ctx != ""), TX.strip_ws(ctx)).alias("highlighted_code"))


JSON_REPORT_SCHEMA = (
    "results array<struct<path:string, check_id:string, start:struct<line:long, col:int>, "
    "extra:struct<severity:string, message:string, lines:string, metadata:struct<cwe:string>>>>"
)


def read_findings_json(spark: SparkSession, path: str, strict_list: bool = True) -> DataFrame:
    """JSON report results[] -> findings; cwe metadata may be a list or a string.

    ``strict_list=True`` keeps the reference behaviour: only list-valued CWE
    metadata yields a cwe_id."""
    r = spark.read.schema(JSON_REPORT_SCHEMA).option("multiLine", True).json(path)
    x = r.select(F.explode("results").alias("r")).select("r.*")
    raw = F.col("extra.metadata.cwe")
    is_list = F.trim(raw).startswith("[")
    first = F.when(is_list, F.get(F.from_json(raw, "array<string>"), 0)).otherwise(F.when(F.lit(not strict_list), raw))
    num = F.get(F.split(first, "-"), 1)
    sev = TX.map_lookup(F.upper(F.coalesce("extra.severity", F.lit("INFO"))), JSON_TOOL_SEVERITY, "LOW")
    return x.filter(F.coalesce("start.line", F.lit(0)) != 0).select(
        F.lit("semgrep").alias("tool"), F.coalesce("check_id", F.lit("unknown")).alias("rule_id"),
        F.when(num.isNotNull(), F.concat(F.lit("CWE-"), F.regexp_extract(num, r"^(\d+)", 1))).alias("cwe_id"),
        F.lit(None).cast("string").alias("cwe_name"), sev.alias("severity"),
        TX.map_lookup(sev, SEVERITY_CONFIDENCE, 0.7).alias("confidence"),
        F.coalesce("extra.message", "check_id", F.lit("Semgrep finding")).alias("message"),
        F.col("path").alias("file_path"), F.col("start.line").alias("line"), F.col("start.col").alias("col"),
        F.when(F.coalesce("extra.lines", F.lit("")) != "", TX.strip_ws("extra.lines")).alias("highlighted_code"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """{predictions:[], probabilities:[], labels:[]} -> one row per example."""
    j = spark.read.option("multiLine", True).schema(
        "predictions array<int>, probabilities array<double>, labels array<int>").json(path)
    z = j.select(F.explode(F.arrays_zip("predictions", "probabilities", "labels")).alias("z"))
    return z.select(F.col("z.predictions").alias("prediction"), F.col("z.probabilities").alias("score"),
                    F.col("z.labels").alias("label"))


# ------------------------------------------------------------------ sinks
def write_corpus_jsonl(df: DataFrame, path: str) -> None:
    cols = ["id", "dataset", "language", "code", "label_binary", "label_cwe", "label_cve"]
    df.select(*cols).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A nested report: one JSON object per row, its arrays and structs as they are."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric rows (a fixed grid, so a few files at most)."""
    df.write.mode("overwrite").json(path)


def write_file(fs: pafs.FileSystem, path: str, content) -> None:
    """A file and its folder."""
    fs.create_dir(posixpath.dirname(path), recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(content)


def write_files(df: DataFrame, root: str) -> int:
    """Rows (path, content) as files under ``root``, a shared folder; returns their number.
    A task that runs again writes the same files again."""

    def run(batches):
        n = 0
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                # a file's bytes are written from the batch, not copied out of it
                write_file(fs, f"{base}/{path}", content.as_buffer() if content.is_valid else b"")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = df.select(F.col("path").cast("string"), F.col("content").cast("binary"))
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_labelled_files(spark: SparkSession, root: str, glob: str = "*.{c,cpp}") -> DataFrame:
    """Test-suite tree: category from the path, label from the file name; files without
    either are left out."""
    from ..operators.corpus import with_path_labels
    t = read_source_tree(spark, root, glob).withColumnRenamed("abs_path", "path")
    return with_path_labels(t, "path").filter(F.col("category").isNotNull() & F.col("label").isNotNull())

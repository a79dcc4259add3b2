"""Corpus-preparation queries (P*, F*, D1-D4, A1-A13, W1-W11, U1) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import corpus as C
from ..sources.fixed import INGEST_EXTENSIONS, MAX_FILE_SIZE, PARSER_EXTENSIONS, SKIP_DIRS
from . import views as V
from .registry import REGISTRY, register

WS = TX.WS_RE2.replace("{", "{{").replace("}", "}}")
WS_HASH_SQL = "sha256(trim(regexp_replace({c}, '[" + WS + "]+', ' ', 'g')))"
STRIP_SQL = "regexp_replace({c}, '\\A[" + WS + "]+|[" + WS + "]+\\z', '', 'g')"
BLANK_SQL = "regexp_matches({c}, '\\A[" + WS + "]*\\z')"
COMMENT_SQL = ("regexp_replace({c}, '(\"[^\"]*(?:\"|\\z)|''[^'']*(?:''|\\z))|//[^\\n]*|/\\*[\\s\\S]*?(?:\\*/|\\z)', "
               "'\\1', 'g')")
KEEP_LANGS = ["en", "fr"]


def _deduped(spark, d):
    c = C.drop_empty(V.v_corpus(spark, d))
    c = C.content_hash(c).select("hash", "id", "dataset", "language", "label_binary", "label_cwe", "ordinal")
    return C.dedup_first(c)


DEDUP_SQL = f"""
WITH c AS (SELECT *, {WS_HASH_SQL.format(c='code')} AS hash FROM v_corpus WHERE NOT {BLANK_SQL.format(c='code')}),
dd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY ordinal) AS rn FROM c) WHERE rn = 1)
"""


# -------------------------------------------------------------- flagship
@register("corpus_label_mix", DEDUP_SQL + """
SELECT dataset, label_binary, count(*) AS n,
       round(CAST(count(*) AS DOUBLE) * 100.0 / CAST(sum(count(*)) OVER (PARTITION BY dataset) AS DOUBLE), 6) AS pct
FROM dd WHERE language IN ('en', 'fr') GROUP BY dataset, label_binary""")
def corpus_label_mix(spark, d):
    """documents+labels -> normalise -> drop empty -> hash -> first-wins dedup -> language filter -> label mix."""
    dd = C.keep_languages(_deduped(spark, d), KEEP_LANGS)
    return C.distribution(dd, ["dataset"], "label_binary")


@register("dedup_first", DEDUP_SQL + "SELECT hash, id, ordinal FROM dd")
def dedup_first(spark, d):
    return _deduped(spark, d).select("hash", "id", "ordinal")


@register("content_hash", f"SELECT id, {WS_HASH_SQL.format(c='code')} AS hash FROM v_corpus")
def content_hash(spark, d):
    return C.content_hash(V.v_corpus(spark, d)).select("id", "hash")


@register("drop_label_conflicts", f"""
WITH c AS (SELECT *, {WS_HASH_SQL.format(c='code')} AS hash FROM v_corpus WHERE label_binary IS NOT NULL),
bad AS (SELECT hash FROM c GROUP BY hash HAVING count(DISTINCT label_binary) > 1)
SELECT id, hash, label_binary FROM c WHERE hash NOT IN (SELECT hash FROM bad)""")
def drop_label_conflicts(spark, d):
    c = C.content_hash(V.v_corpus(spark, d).filter(F.col("label_binary").isNotNull()))
    return C.drop_label_conflicts(c).select("id", "hash", "label_binary")


# -------------------------------------------------------------- distributions
@register("label_distribution", """
SELECT label_binary, count(*) AS n, round(CAST(count(*) AS DOUBLE) * 100.0 / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS pct
FROM v_corpus GROUP BY label_binary""")
def label_distribution(spark, d):
    return C.distribution(V.v_corpus(spark, d), [], "label_binary")


@register("language_distribution", """
SELECT language, count(*) AS n, round(CAST(count(*) AS DOUBLE) * 100.0 / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS pct
FROM v_corpus GROUP BY language""")
def language_distribution(spark, d):
    return C.distribution(V.v_corpus(spark, d), [], "language")


@register("fill_rates", """
SELECT count(*) AS n,
       count(label_cwe) AS label_cwe_filled, round(CAST(count(label_cwe) AS DOUBLE) * 100.0 / CAST(count(*) AS DOUBLE), 6) AS label_cwe_pct,
       count(label_cve) AS label_cve_filled, round(CAST(count(label_cve) AS DOUBLE) * 100.0 / CAST(count(*) AS DOUBLE), 6) AS label_cve_pct,
       count(label_binary) AS label_binary_filled,
       round(CAST(count(label_binary) AS DOUBLE) * 100.0 / CAST(count(*) AS DOUBLE), 6) AS label_binary_pct
FROM v_corpus""")
def fill_rates(spark, d):
    return C.fill_rates(V.v_corpus(spark, d), ["label_cwe", "label_cve", "label_binary"])


_LANG_SQL = """CASE WHEN programming_language IS NULL OR lower(trim(programming_language)) = '' THEN 'unknown'
   WHEN lower(trim(programming_language)) = 'c++' THEN 'cpp' ELSE lower(trim(programming_language)) END"""
_FUNC_SQL = f"CASE WHEN func IS NULL THEN 'error' WHEN {BLANK_SQL.format(c='func')} THEN 'skipped_empty_code' ELSE 'success' END"


@register("skip_reasons", f"""
SELECT dataset, reason, count(*) AS n FROM (
  SELECT 'zenodo' AS dataset, CASE WHEN {BLANK_SQL.format(c="coalesce(vul_code, '')")} THEN 'skipped_empty_code'
     WHEN ({_LANG_SQL}) NOT IN ('c', 'cpp') THEN 'skipped_language_' || ({_LANG_SQL}) ELSE 'success' END AS reason FROM v_raw_zenodo
  UNION ALL SELECT 'devign', {_FUNC_SQL} FROM v_raw_devign
  UNION ALL SELECT 'diversevul', {_FUNC_SQL} FROM v_raw_diversevul
  UNION ALL SELECT 'megavul', {_FUNC_SQL} FROM v_raw_megavul) u GROUP BY 1, 2""")
def skip_reasons(spark, d):
    """A4: accepted and rejected records by reason, for each raw dataset (no accumulators)."""
    parts = [("zenodo", V.v_raw_zenodo, C.reason_zenodo()), ("devign", V.v_raw_devign, C.reason_func()),
             ("diversevul", V.v_raw_diversevul, C.reason_func()), ("megavul", V.v_raw_megavul, C.reason_func())]
    out = None
    for name, view, reason in parts:
        q = C.skip_reasons(view(spark, d), reason).withColumn("dataset", F.lit(name))
        out = q if out is None else out.unionByName(q)
    return out


# -------------------------------------------------------------- normalisers
NORM_COLS = "id, dataset, language, code, label_binary, label_cwe, label_cve"


@register("normalize_zenodo", f"""
WITH r AS (SELECT ordinal, {STRIP_SQL.format(c="coalesce(vul_code, '')")} AS code,
   CASE WHEN programming_language IS NULL OR lower(trim(programming_language)) = '' THEN 'unknown'
        WHEN lower(trim(programming_language)) = 'c++' THEN 'cpp' ELSE lower(trim(programming_language)) END AS language,
   coalesce(is_vulnerable, FALSE) AS v, cwe_id, cve_id FROM v_raw_zenodo)
SELECT 'zenodo_' || CAST(ordinal AS VARCHAR) AS id, 'zenodo' AS dataset, language, code, CAST(v AS INTEGER) AS label_binary,
       nullif(cwe_id, '') AS label_cwe, nullif(cve_id, '') AS label_cve
FROM r WHERE code <> '' AND language IN ('c', 'cpp')""")
def normalize_zenodo(spark, d):
    return C.normalize_zenodo(V.v_raw_zenodo(spark, d))


@register("normalize_devign", f"""
SELECT 'devign_' || coalesce(commit_id, CAST(ordinal AS VARCHAR)) AS id, 'devign' AS dataset, 'c' AS language,
       {STRIP_SQL.format(c='func')} AS code, coalesce(CAST(target AS INTEGER), 0) AS label_binary,
       CAST(NULL AS VARCHAR) AS label_cwe, CAST(NULL AS VARCHAR) AS label_cve
FROM v_raw_devign WHERE func IS NOT NULL AND {STRIP_SQL.format(c='func')} <> ''""")
def normalize_devign(spark, d):
    return C.normalize_devign(V.v_raw_devign(spark, d))


@register("normalize_diversevul", f"""
WITH r AS (SELECT ordinal, {STRIP_SQL.format(c="coalesce(func, '')")} AS code, target, cwe, message FROM v_raw_diversevul),
k AS (SELECT *, row_number() OVER (ORDER BY ordinal) - 1 AS acc FROM r WHERE code <> '')
SELECT 'diversevul_' || CAST(acc AS VARCHAR) AS id, 'diversevul' AS dataset, 'c' AS language, code,
       coalesce(CAST(target AS INTEGER), 0) AS label_binary,
       CASE WHEN starts_with(trim(cwe), '[') THEN json_extract_string(cwe, '$[0]') ELSE nullif(cwe, '') END AS label_cwe,
       nullif(regexp_extract(message, 'CVE-\\d{{4}}-\\d{{4,5}}', 0), '') AS label_cve
FROM k""")
def normalize_diversevul(spark, d):
    return C.normalize_diversevul(V.v_raw_diversevul(spark, d))


@register("normalize_megavul", f"""
WITH r AS (SELECT ordinal, {STRIP_SQL.format(c="coalesce(func, '')")} AS code, is_vul, cve_id, cwe_ids FROM v_raw_megavul)
SELECT 'megavul_' || CAST(ordinal AS VARCHAR) AS id, 'megavul' AS dataset, 'c' AS language, code,
       CAST(coalesce(is_vul, FALSE) AS INTEGER) AS label_binary,
       CASE WHEN starts_with(trim(cwe_ids), '[') THEN json_extract_string(cwe_ids, '$[0]') ELSE nullif(cwe_ids, '') END AS label_cwe,
       nullif(cve_id, '') AS label_cve
FROM r WHERE code <> ''""")
def normalize_megavul(spark, d):
    return C.normalize_megavul(V.v_raw_megavul(spark, d))


# -------------------------------------------------------------- labelled files
LABEL_SQL = """CASE WHEN contains(fname, '_bad.') OR contains(fname, '_bad_') THEN 1
     WHEN (contains(fname, '_good.') OR contains(fname, '_good_'))
          AND (contains(fname, 'goodG2B') OR contains(fname, 'goodB2G') OR contains(fname, 'good2')) THEN 1
     WHEN contains(fname, '_good.') OR contains(fname, '_good_') THEN 0 END"""
LF_SQL = f"""
lf AS (SELECT *, CASE WHEN regexp_extract(path, 'CWE(\\d+)', 1) <> '' THEN 'CWE' || regexp_extract(path, 'CWE(\\d+)', 1) END
              AS category, {LABEL_SQL} AS label
       FROM (SELECT *, regexp_extract(path, '([^/\\\\]*)$', 1) AS fname FROM v_labelled_files))"""


@register("path_labels", f"WITH {LF_SQL} SELECT page_id, path, category, label FROM lf")
def path_labels(spark, d):
    return C.with_path_labels(V.v_labelled_files(spark, d)).select("page_id", "path", "category", "label")


_LF_REASON = f"""CASE WHEN category IS NULL THEN 'no_category' WHEN label IS NULL THEN 'no_label'
  WHEN content IS NULL OR {BLANK_SQL.format(c='content')} THEN 'empty' WHEN length(content) > 100000 THEN 'too_long' END"""


@register("normalize_labelled", f"""WITH {LF_SQL}
SELECT content AS func, CAST(label AS INTEGER) AS target, 'suite' AS project, category AS commit_id, fname AS file_path
FROM lf WHERE ({_LF_REASON}) IS NULL""")
def normalize_labelled(spark, d):
    return C.normalize_labelled(C.with_path_labels(V.v_labelled_files(spark, d)))


@register("skipped_labelled", f"WITH {LF_SQL} SELECT path, {_LF_REASON} AS reason FROM lf WHERE ({_LF_REASON}) IS NOT NULL")
def skipped_labelled(spark, d):
    """P5's other half: the files it leaves out, with the reason."""
    return C.skipped_labelled(C.with_path_labels(V.v_labelled_files(spark, d)))


def _split_values_sql():
    rows = C.split_map_rows()
    return "(VALUES " + ", ".join(f"('{c}', '{s}')" for c, s in rows) + ") AS sm(category, split)"


@register("category_split", f"""WITH {LF_SQL}
SELECT lf.page_id, lf.category, sm.split FROM lf JOIN {_split_values_sql()} ON lf.category = sm.category""")
def category_split(spark, d):
    lf = C.with_path_labels(V.v_labelled_files(spark, d))
    return C.assign_category_split(lf).select("page_id", "category", "split")


@register("category_label_counts", f"""WITH {LF_SQL}
SELECT category, count(*) AS total, count(*) FILTER (WHERE label = 1) AS vulnerable,
       count(*) FILTER (WHERE label = 0) AS safe
FROM lf GROUP BY category""")
def category_label_counts(spark, d):
    lf = C.with_path_labels(V.v_labelled_files(spark, d))
    return lf.groupBy("category").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") == 1).alias("vulnerable"),
        F.count_if(F.col("label") == 0).alias("safe"))


@register("split_categories_common", f"""WITH {LF_SQL},
u AS (SELECT category, CAST(('0x' || substr(sha256('42:' || CAST(page_id AS VARCHAR)), 1, 12))::UBIGINT AS DOUBLE) / CAST(16 ^ 12 AS DOUBLE) AS u FROM lf)
SELECT category FROM u WHERE u < 0.8 INTERSECT SELECT category FROM u WHERE u >= 0.9""")
def split_categories_common(spark, d):
    """Categories that the train and the test part of a random split share."""
    s = C.hash_bucket_split(C.with_path_labels(V.v_labelled_files(spark, d)), "page_id", fracs=(0.8, 0.1, 0.1))
    return C.split_categories_common(s.filter("split = 'train'"), s.filter("split = 'test'"))


@register("category_sample", f"""WITH {LF_SQL},
h AS (SELECT *, sha256('42:' || CAST(page_id AS VARCHAR)) AS hh FROM lf WHERE label IS NOT NULL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY hh, page_id) AS rk FROM h) WHERE rk <= 10)
SELECT page_id, category, label FROM t ORDER BY hh, page_id LIMIT 100""")
def category_sample(spark, d):
    """Per category top max(10, target//20) by seeded hash, then the overall top ``target``."""
    lf = C.with_path_labels(V.v_labelled_files(spark, d)).filter(F.col("label").isNotNull())
    return C.category_sample(lf, "category", key="page_id", target=100).select("page_id", "category", "label")


# -------------------------------------------------------------- projections
@register("file_language", """
SELECT page_id, lower(regexp_extract(regexp_extract(path, '([^/\\\\]*)$', 1), '(\\.[^./]+)$', 1)) AS ext,
       CASE lower(regexp_extract(regexp_extract(path, '([^/\\\\]*)$', 1), '(\\.[^./]+)$', 1))
       """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PARSER_EXTENSIONS.items()) + """ END AS language
FROM v_labelled_files""")
def file_language(spark, d):
    lf = V.v_labelled_files(spark, d).withColumn("ext", TX.extension("path"))
    return C.with_language(lf, "path", PARSER_EXTENSIONS).select("page_id", "ext", "language")


@register("units_uid", "SELECT uid, file_path, function_name, start_line, end_line, n_lines FROM v_units")
def units_uid(spark, d):
    return V.v_units(spark, d).select("uid", "file_path", "function_name", "start_line", "end_line", "n_lines")


@register("snippet", """
SELECT id, CASE WHEN length(code) > 500 THEN substr(code, 1, 500) || '...' ELSE code END AS snippet FROM v_corpus""")
def snippet(spark, d):
    return C.with_snippet(V.v_corpus(spark, d)).select("id", "snippet")


@register("clean_code", f"""
SELECT page_id, sha256(c) AS cleaned_hash, length(c) AS cleaned_len
FROM (SELECT page_id, trim(regexp_replace({COMMENT_SQL.format(c='content')}, '[{TX.WS_RE2}]+', ' ', 'g')) AS c FROM v_files)""")
def clean_code(spark, d):
    f = C.clean_code(V.v_files(spark, d), "content", "c")
    return f.select("page_id", F.sha2("c", 256).alias("cleaned_hash"), F.length("c").alias("cleaned_len"))


@register("text_metrics", f"""
SELECT id, len(string_split(code, chr(10))) AS total_lines,
       len(list_filter(string_split(code, chr(10)), lambda x: NOT {BLANK_SQL.format(c='x')})) AS non_empty_lines,
       length(code) AS n_chars,
       round(CAST(list_sum(list_transform(string_split(code, chr(10)), lambda x: length(x))) AS DOUBLE)
             / CAST(len(string_split(code, chr(10))) AS DOUBLE), 6) AS avg_line_length
FROM v_corpus""")
def text_metrics(spark, d):
    m = C.text_metrics(V.v_corpus(spark, d))
    return m.select("id", "total_lines", "non_empty_lines", "n_chars", F.round("avg_line_length", 6).alias("avg_line_length"))


@register("training_pairs", "SELECT code AS text, label_binary AS label FROM v_corpus WHERE label_binary IS NOT NULL")
def training_pairs(spark, d):
    return C.to_training_pairs(V.v_corpus(spark, d).filter(F.col("label_binary").isNotNull()))


@register("file_name", "SELECT page_id, regexp_extract(path, '([^/\\\\]*)$', 1) AS file_name FROM v_files")
def file_name(spark, d):
    return V.v_files(spark, d).select("page_id", TX.file_name("path").alias("file_name"))


# -------------------------------------------------------------- filters
@register("quality_gate", """
SELECT id FROM v_corpus WHERE length(code) >= 50 AND length(code) - length(replace(code, chr(10), '')) + 1 >= 3
  AND dataset NOT IN ('src0', 'src1')""")
def quality_gate(spark, d):
    c = C.exclude_datasets(V.v_corpus(spark, d), ["src0", "src1"])
    return C.quality_gate(c).select("id")


@register("function_length", "SELECT uid FROM v_units WHERE length(code) > 10 AND length(code) < 5000")
def function_length(spark, d):
    return C.function_length(V.v_units(spark, d)).select("uid")


_F6_SQL = f"""
WITH s AS (SELECT *, string_split(regexp_replace(path, '^[a-z]+://[^/]*', ''), '/') AS segs,
                  lower(regexp_extract(regexp_extract(path, '([^/\\\\]*)$', 1), '(\\.[^./]+)$', 1)) AS ext
           FROM (SELECT page_id, path, size FROM v_labelled_files JOIN (SELECT page_id, size FROM v_files) USING (page_id))),
t AS (SELECT *, list_slice(segs, 1, greatest(len(segs) - 1, 0)) AS dirs FROM s),
r AS (SELECT page_id, path, ext, CASE WHEN len(list_filter(dirs, lambda x: x IN ({', '.join(repr(x) for x in SKIP_DIRS)}))) > 0 THEN 'skip_dir'
            WHEN len(list_filter(dirs, lambda x: starts_with(x, '.') AND length(x) > 1)) > 0 THEN 'hidden_dir'
            WHEN ext NOT IN ({', '.join(repr(x) for x in INGEST_EXTENSIONS)}) THEN 'extension'
            WHEN size > {{max_size}} THEN 'too large (' || format('{{{{:,}}}}', size) || ' bytes)' END AS reason FROM t)
"""
_SMALL = 5000  # a size rule that some pages break


def _sized_files(spark, d):
    return V.v_labelled_files(spark, d).join(V.v_files(spark, d).select("page_id", "size"), "page_id")


@register("source_file_filter", _F6_SQL.format(max_size=MAX_FILE_SIZE) + """
SELECT coalesce(CASE WHEN starts_with(reason, 'too large') THEN 'too large' ELSE reason END, 'accepted') AS reason, count(*) AS n FROM r GROUP BY 1""")
def source_file_filter(spark, d):
    """files by reason; one pass."""
    r = F.coalesce(C.source_file_reason("path"), F.lit("accepted"))
    return _sized_files(spark, d).groupBy(F.when(r.startswith("too large"), "too large").otherwise(r).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))


@register("accepted_files", _F6_SQL.format(max_size=MAX_FILE_SIZE) + f"""
SELECT page_id, path, CASE ext {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in INGEST_EXTENSIONS.items())} END AS language
FROM r WHERE reason IS NULL""")
def accepted_files(spark, d):
    return C.accepted_files(_sized_files(spark, d), "path").select("page_id", "path", "language")


@register("skipped_files", _F6_SQL.format(max_size=_SMALL) + "SELECT path, reason FROM r WHERE starts_with(reason, 'too large')")
def skipped_files(spark, d):
    """The reported half of F6, under a size rule of 5,000 bytes."""
    f = _sized_files(spark, d)
    r = C.source_file_reason("path", max_size=_SMALL)
    return f.select("path", r.alias("reason")).filter(F.col("reason").startswith("too large"))


# -------------------------------------------------------------- weights, balance, split
@register("class_weights", """
SELECT count(*) AS n, count_if(label_binary = 1) AS n_vulnerable, count_if(label_binary = 0) AS n_safe,
       round(CAST(count_if(label_binary = 1) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS w_safe,
       round(CAST(count_if(label_binary = 0) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 2.5, 6) AS w_vulnerable
FROM v_corpus WHERE label_binary IS NOT NULL""")
def class_weights(spark, d):
    return C.class_weights(V.v_corpus(spark, d).filter(F.col("label_binary").isNotNull()))


@register("sample_weights", """
WITH c AS (SELECT * FROM v_corpus WHERE label_binary IS NOT NULL),
r AS (SELECT CAST(count_if(label_binary = 0) AS DOUBLE) / CAST(count_if(label_binary = 1) AS DOUBLE) AS r FROM c)
SELECT id, CASE WHEN label_binary = 1 THEN round((SELECT r FROM r) / 2.5, 6) ELSE 1.0 END AS weight FROM c""")
def sample_weights(spark, d):
    c = V.v_corpus(spark, d).filter(F.col("label_binary").isNotNull())
    return C.sample_weights(c).select("id", "weight")


@register("undersample", """
WITH c AS (SELECT id, label_binary, sha256('42:' || id) AS h FROM v_corpus WHERE label_binary IS NOT NULL),
m AS (SELECT count_if(label_binary = 1) AS nv FROM c)
SELECT id, label_binary FROM c WHERE label_binary = 1
UNION ALL
SELECT id, label_binary FROM (SELECT *, row_number() OVER (ORDER BY h, id) AS rk FROM c WHERE label_binary = 0)
WHERE rk <= 3 * (SELECT nv FROM m)""")
def undersample(spark, d):
    c = V.v_corpus(spark, d).filter(F.col("label_binary").isNotNull()).select("id", "label_binary")
    return C.undersample(c, ratio=3)


@register("oversample", """
WITH c AS (SELECT * FROM v_corpus WHERE label_binary IS NOT NULL),
r AS (SELECT CAST(count_if(label_binary = 0) AS DOUBLE) / CAST(count_if(label_binary = 1) AS DOUBLE) AS r FROM c),
w AS (SELECT id, CASE WHEN label_binary = 1 THEN round((SELECT r FROM r) / 2.5, 6) ELSE 1.0 END AS weight FROM c),
u AS (SELECT *, CAST(('0x' || substr(sha256('42:' || id), 1, 12))::UBIGINT AS DOUBLE) / CAST(16 ^ 12 AS DOUBLE) AS u FROM w),
n AS (SELECT id, CAST(floor(weight) AS INTEGER) + CASE WHEN u < weight - floor(weight) THEN 1 ELSE 0 END AS k FROM u)
SELECT id, count(*) AS copies FROM n, range(1, k + 1) AS t(copy) WHERE k > 0 GROUP BY id""")
def oversample(spark, d):
    c = V.v_corpus(spark, d).filter(F.col("label_binary").isNotNull())
    o = C.oversample(C.sample_weights(c))
    return o.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))


SPLIT_SQL = """
WITH c AS (SELECT id, label_binary, sha256('42:' || id) AS h FROM v_corpus WHERE label_binary IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY label_binary ORDER BY h, id) AS rk,
             count(*) OVER (PARTITION BY label_binary) AS n FROM c),
s AS (SELECT id, label_binary, CASE WHEN rk <= floor(n * 0.8) THEN 'train'
                         WHEN rk <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r)
"""


def _split(spark, d):
    c = V.v_corpus(spark, d).filter(F.col("label_binary").isNotNull()).select("id", "label_binary")
    return C.stratified_split(c, ["label_binary"])


@register("stratified_split", SPLIT_SQL + "SELECT id, label_binary, split FROM s")
def stratified_split(spark, d):
    return _split(spark, d)


@register("stratified_split_null", """
WITH c AS (SELECT id, label_cwe, sha256('42:' || id) AS h FROM v_corpus),
r AS (SELECT *, row_number() OVER (PARTITION BY label_cwe ORDER BY h, id) AS rk, count(*) OVER (PARTITION BY label_cwe) AS n FROM c)
SELECT id, label_cwe, CASE WHEN rk <= floor(n * 0.8) THEN 'train'
       WHEN rk <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r""")
def stratified_split_null(spark, d):
    """W4 by category, where rows without one are a stratum of their own."""
    return C.stratified_split(V.v_corpus(spark, d).select("id", "label_cwe"), ["label_cwe"])


@register("split_label_counts", SPLIT_SQL + """
SELECT split, count(*) AS n, round(CAST(count(*) AS DOUBLE) * 100.0 / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS pct,
       count_if(label_binary = 1) AS n_vulnerable, count_if(label_binary = 0) AS n_safe
FROM s GROUP BY split""")
def split_label_counts(spark, d):
    s = _split(spark, d)
    g = s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label_binary") == 1).alias("n_vulnerable"),
                               F.count_if(F.col("label_binary") == 0).alias("n_safe"))
    from pyspark.sql import Window
    return g.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


@register("split_overlap", SPLIT_SQL + f"""
, hh AS (SELECT s.split, {WS_HASH_SQL.format(c='v.code')} AS hash FROM s JOIN v_corpus v USING (id))
SELECT a.split AS split_a, b.split AS split_b, count(DISTINCT a.hash) AS shared_hashes
FROM hh a JOIN hh b ON a.hash = b.hash AND a.split < b.split GROUP BY 1, 2""")
def split_overlap(spark, d):
    """Leakage check: content hashes present in two splits (self equi join on hash)."""
    s = _split(spark, d).join(C.content_hash(V.v_corpus(spark, d)).select("id", "hash"), "id")
    per = s.select("split", "hash").distinct()
    a, b = per.alias("a"), per.alias("b")
    j = a.join(b, (F.col("a.hash") == F.col("b.hash")) & (F.col("a.split") < F.col("b.split")))
    return j.groupBy(F.col("a.split").alias("split_a"), F.col("b.split").alias("split_b")).agg(
        F.countDistinct("a.hash").alias("shared_hashes"))


@register("hash_bucket_split", """
SELECT id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8 + 0.1 THEN 'val' ELSE 'test' END AS split
FROM (SELECT id, CAST(('0x' || substr(sha256('42:' || id), 1, 12))::UBIGINT AS DOUBLE) / CAST(16 ^ 12 AS DOUBLE) AS u FROM v_corpus)""")
def hash_bucket_split(spark, d):
    return C.hash_bucket_split(V.v_corpus(spark, d)).select("id", "split")


@register("every_nth", "SELECT id FROM v_corpus WHERE ordinal % 10 = 0")
def every_nth(spark, d):
    return C.every_nth(V.v_corpus(spark, d)).select("id")


@register("group_rare", """
WITH c AS (SELECT dataset || '/' || label_cwe AS category FROM v_corpus WHERE label_cwe IS NOT NULL),
n AS (SELECT category, count(*) AS c FROM c GROUP BY category)
SELECT CASE WHEN n.c < 5 THEN 'other_rare' ELSE c.category END AS category, count(*) AS n
FROM c JOIN n USING (category) GROUP BY 1""")
def group_rare(spark, d):
    c = V.v_corpus(spark, d).filter(F.col("label_cwe").isNotNull()).select(
        F.concat_ws("/", "dataset", "label_cwe").alias("category"))
    return C.group_rare(c, "category", 5).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@register("funnel_stats", DEDUP_SQL + """
, cc AS (SELECT * FROM v_corpus)
SELECT (SELECT count(*) FROM cc) AS n_loaded,
       (SELECT count(*) FROM dd) AS n_after_dedup,
       (SELECT count(*) FROM dd WHERE language IN ('en', 'fr')) AS n_after_language,
       (SELECT count_if(label_binary = 1) FROM dd WHERE language IN ('en', 'fr')) AS n_vulnerable,
       (SELECT count_if(label_binary = 0) FROM dd WHERE language IN ('en', 'fr')) AS n_safe,
       (SELECT count_if(label_binary = 1) + least(count_if(label_binary = 0), 3 * count_if(label_binary = 1))
        FROM dd WHERE language IN ('en', 'fr')) AS n_after_undersample""")
def funnel_stats(spark, d):
    """Rows after each preparation step.  Counts come from the first-wins
    dedup aggregate (partial min_by per hash), so a hash shared by a third of
    the rows is reduced map-side instead of being joined back row by row."""
    n_loaded = V.v_corpus(spark, d).select(F.count(F.lit(1))).scalar()
    dd = _deduped(spark, d)
    lang = F.col("language").isin(*KEEP_LANGS)
    agg = dd.agg(
        F.count(F.lit(1)).alias("n_after_dedup"), F.count_if(lang).alias("n_after_language"),
        F.count_if(lang & (F.col("label_binary") == 1)).alias("n_vulnerable"),
        F.count_if(lang & (F.col("label_binary") == 0)).alias("n_safe"))
    return agg.select(n_loaded.alias("n_loaded"), "*").withColumn(
        "n_after_undersample", F.col("n_vulnerable") + F.least(F.col("n_safe"), F.col("n_vulnerable") * 3))


# -------------------------------------------------------------- tokens and windows
TOKEN_RE = r"\w+|[^\w\s]"


@register("token_windows", """
WITH t AS (SELECT id, regexp_extract_all(code, '\\w+|[^\\w\\s]', 0) AS tokens FROM v_corpus),
n AS (SELECT id, tokens, len(tokens) AS n,
             CASE WHEN len(tokens) <= 510 THEN 1 ELSE 1 + CAST(ceil((len(tokens) - 510) / 256) AS INTEGER) END AS k FROM t),
w AS (SELECT id, n, s.i AS chunk_idx, tokens[s.i * 256 + 1 : s.i * 256 + 510] AS chunk FROM n, range(0, k) AS s(i))
SELECT id, chunk_idx, len(chunk) AS chunk_len, chunk[1] AS first_token, chunk[len(chunk)] AS last_token FROM w""")
def token_windows(spark, d):
    t = V.v_corpus(spark, d).select("id", TX.regex_tokens("code", TOKEN_RE).alias("tokens"))
    w = C.token_windows(t, "tokens", 510, 256)
    return w.select("id", "chunk_idx", F.size("chunk").alias("chunk_len"),
                    F.get("chunk", 0).alias("first_token"), F.get("chunk", F.size("chunk") - 1).alias("last_token"))


@register("chunk_stats", """
WITH t AS (SELECT len(regexp_extract_all(code, '\\w+|[^\\w\\s]', 0)) AS n FROM v_corpus),
k AS (SELECT CASE WHEN n <= 510 THEN 1 ELSE 1 + CAST(ceil((n - 510) / 256) AS INTEGER) END AS k FROM t)
SELECT count_if(k = 1) AS single_chunk, count_if(k > 1) AS multi_chunk, CAST(sum(k) AS BIGINT) AS total_chunks FROM k""")
def chunk_stats(spark, d):
    t = V.v_corpus(spark, d).select("id", TX.regex_tokens("code", TOKEN_RE).alias("tokens"))
    return C.chunk_stats(t)


@register("pad_truncate", """
WITH t AS (SELECT id, list_transform(regexp_extract_all(code, '\\w+|[^\\w\\s]', 0), lambda x: length(x)) AS ids FROM v_corpus)
SELECT id, len(ids) AS n_tokens, least(len(ids), 64) AS n_attended,
       CAST(coalesce(list_sum(ids[1:64]), 0) AS BIGINT) AS id_sum FROM t""")
def pad_truncate(spark, d):
    """Token ids (here: token lengths) cut/padded to 64 with a mask; summarised per row."""
    t = V.v_corpus(spark, d).select("id", F.transform(TX.regex_tokens("code", TOKEN_RE), lambda x: F.length(x)).alias("ids"))
    p = C.pad_truncate(t, "ids", 64, 0)
    return p.select("id", F.size("ids").alias("n_tokens"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_attended"),
                    F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


# -------------------------------------------------------------- validation
def _validated(spark, d):
    """The corpus written twice as JSONL: with every key (nulls kept) and with
    null keys dropped, read back as raw lines and validated."""
    from ..session import shared_path
    from ..sources import files as FS
    c = V.v_corpus(spark, d)
    full, sparse = shared_path(spark, "val-full"), shared_path(spark, "val-sparse")
    FS.write_corpus_jsonl(c, full)
    c.select(*C.CORPUS_COLS).write.mode("overwrite").option("ignoreNullFields", True).json(sparse)
    lines = (spark.read.text(full).withColumn("variant", F.lit("full"))
             .unionByName(spark.read.text(sparse).withColumn("variant", F.lit("sparse"))))
    return C.validate_lines(lines)


VALIDATE_SQL = f"""
WITH b AS (SELECT dataset, language, label_binary, label_cwe, label_cve, {STRIP_SQL.format(c='code')} = '' AS empty FROM v_corpus),
u AS (
  SELECT 'full' AS variant, dataset, language, label_binary, label_cwe, label_cve,
         CASE WHEN empty THEN 'empty_code' WHEN label_binary IS NULL THEN 'invalid_label_None'
              WHEN label_binary NOT IN (0, 1) THEN 'invalid_label_' || CAST(label_binary AS VARCHAR) END AS error FROM b
  UNION ALL
  SELECT 'sparse', dataset, language, label_binary, label_cwe, label_cve,
         CASE WHEN label_binary IS NULL THEN 'missing_field_label_binary' WHEN label_cwe IS NULL THEN 'missing_field_label_cwe'
              WHEN label_cve IS NULL THEN 'missing_field_label_cve' WHEN empty THEN 'empty_code'
              WHEN label_binary NOT IN (0, 1) THEN 'invalid_label_' || CAST(label_binary AS VARCHAR) END FROM b)
"""


@register("validate_corpus", VALIDATE_SQL + """
SELECT variant, dataset, coalesce(error, 'valid') AS outcome, count(*) AS n FROM u GROUP BY variant, dataset, outcome""")
def validate_corpus(spark, d):
    """A5: first failing check per record, counted per dataset; missing keys vs nulls."""
    v = _validated(spark, d)
    return v.groupBy("variant", "dataset", F.coalesce("error", F.lit("valid")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"))


def _percent_sql(part: str, whole: str) -> str:
    tenths = f"((2000 * ({part}) + {whole}) // (2 * {whole}))"
    return f"({tenths} // 10)::BIGINT || '.' || ({tenths} % 10)::BIGINT || '%'"


_ISSUES_SQL = f"""list_filter([
    CASE WHEN valid = 0 THEN 'No valid records found' END,
    CASE WHEN valid > 0 AND valid < total AND CAST(total - valid AS DOUBLE) * 100.0 / CAST(total AS DOUBLE) > 10
         THEN {_percent_sql('total - valid', 'total')} || ' of records are invalid' END,
    CASE WHEN valid > 0 AND n_safe > 0 AND CAST(n_safe AS DOUBLE) * 100.0 / CAST(valid AS DOUBLE) < 2 THEN 'Class imbalance: Safe is only ' || {_percent_sql('n_safe', 'valid')} END,
    CASE WHEN valid > 0 AND n_vulnerable > 0 AND CAST(n_vulnerable AS DOUBLE) * 100.0 / CAST(valid AS DOUBLE) < 2
         THEN 'Class imbalance: Vulnerable is only ' || {_percent_sql('n_vulnerable', 'valid')} END,
    CASE WHEN n_valid_language = 0 THEN 'No valid languages found' END], lambda x: x IS NOT NULL)"""


@register("corpus_verdicts", VALIDATE_SQL + f"""
, a AS (SELECT variant, dataset, count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS valid,
              count(*) FILTER (WHERE error IS NULL AND label_binary = 0) AS n_safe,
              count(*) FILTER (WHERE error IS NULL AND label_binary = 1) AS n_vulnerable,
              count(*) FILTER (WHERE error IS NULL AND language IN ('c', 'cpp')) AS n_valid_language,
              count(*) FILTER (WHERE error IS NULL AND label_cwe IS NULL) AS empty_cwe,
              count(*) FILTER (WHERE error IS NULL AND label_cve IS NULL) AS empty_cve
       FROM u GROUP BY variant, dataset)
SELECT variant, dataset, total, valid, round(CAST(total - valid AS DOUBLE) * 100.0 / CAST(total AS DOUBLE), 6) AS invalid_pct,
       n_safe, n_vulnerable, empty_cwe, empty_cve, array_to_string({_ISSUES_SQL}, '; ') AS issues,
       len({_ISSUES_SQL}) = 0 AS is_safe, bool_and(len({_ISSUES_SQL}) = 0) OVER (PARTITION BY variant) AS all_safe
FROM a""")
def corpus_verdicts(spark, d):
    """A6 + A7: per-dataset verdict (issues list) and the all-datasets-safe flag."""
    from pyspark.sql import Window
    r = C.corpus_verdict(_validated(spark, d), ["variant", "dataset"])
    return r.withColumn("all_safe", F.bool_and("is_safe").over(Window.partitionBy("variant")))


@register("token_counts", """
SELECT id, len(regexp_extract_all(code, '\\w+|[^\\w\\s]', 0)) AS n_tokens,
       len(list_distinct(regexp_extract_all(code, '\\w+|[^\\w\\s]', 0))) AS n_distinct FROM v_corpus""")
def token_counts(spark, d):
    """U1 default tokenizer (regex tokens, JVM side)."""
    t = C.tokenize(V.v_corpus(spark, d))
    return t.select("id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_distinct"))


# -------------------------------------------------------------- end-to-end preparation (entry 2)
@register("prepare_corpus", DEDUP_SQL + f"""
, l AS (SELECT id, label_binary, sha256('42:' || id) AS h FROM dd WHERE language IN ('en', 'fr') AND label_binary IS NOT NULL),
us AS (SELECT id, label_binary FROM l WHERE label_binary = 1
       UNION ALL
       SELECT id, label_binary FROM (SELECT *, row_number() OVER (ORDER BY h, id) AS rk FROM l WHERE label_binary = 0) z
       WHERE rk <= 3 * (SELECT count(*) FROM l WHERE label_binary = 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY label_binary ORDER BY sha256('42:' || id), id) AS rk,
             count(*) OVER (PARTITION BY label_binary) AS n FROM us),
sp AS (SELECT id, label_binary, CASE WHEN rk <= floor(n * 0.8) THEN 'train'
                  WHEN rk <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r),
tk AS (SELECT sp.*, len(regexp_extract_all(trim(regexp_replace({COMMENT_SQL.format(c='v.code')}, '[{TX.WS_RE2}]+', ' ', 'g')),
                                           '\\w+|[^\\w\\s]', 0)) AS n_tokens
       FROM sp JOIN v_corpus v USING (id))
SELECT id, label_binary, split, n_tokens,
       CASE WHEN n_tokens <= 510 THEN 1 ELSE 1 + CAST(ceil((n_tokens - 510) / 256) AS INTEGER) END AS n_chunks FROM tk""")
def prepare_corpus(spark, d):
    """Load -> drop empty -> hash -> first-wins dedup -> language filter -> undersample 3:1 ->
    clean -> token windows -> stratified 80/10/10 split, as one plan."""
    c = V.v_corpus(spark, d)
    dd = C.keep_languages(_deduped(spark, d), KEEP_LANGS).filter(F.col("label_binary").isNotNull())
    bal = C.undersample(dd.select("id", "label_binary"), ratio=3)
    sp = C.stratified_split(bal, ["label_binary"])
    # the texts join what is kept, and only those are cleaned
    tok = C.tokenize(C.clean_code(sp.join(c.select("id", "code"), "id")), "code", out="tokens")
    return tok.select("id", "label_binary", "split", F.size("tokens").alias("n_tokens"), C.n_windows(F.size("tokens")).alias("n_chunks"))


@register("preparation_funnel", None)
def preparation_funnel(spark, d):
    """A10, last steps: balanced rows, single and multiple chunks, all chunks, and chunks per split."""
    p = prepare_corpus(spark, d)
    per = lambda s: F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n_chunks"))), F.lit(0)).cast("long")
    return p.agg(F.count(F.lit(1)).alias("n_balanced"), F.count_if(F.col("n_chunks") == 1).alias("single_chunks"),
                 F.count_if(F.col("n_chunks") > 1).alias("multi_chunks"), F.sum("n_chunks").cast("long").alias("total_chunks"),
                 per("train").alias("train"), per("val").alias("val"), per("test").alias("test"))


REGISTRY["preparation_funnel"] = (preparation_funnel, f"""SELECT count(*) AS n_balanced, count_if(n_chunks = 1) AS single_chunks,
  count_if(n_chunks > 1) AS multi_chunks, CAST(sum(n_chunks) AS BIGINT) AS total_chunks,
  CAST(coalesce(sum(n_chunks) FILTER (split = 'train'), 0) AS BIGINT) AS train, CAST(coalesce(sum(n_chunks) FILTER (split = 'val'), 0) AS BIGINT) AS val,
  CAST(coalesce(sum(n_chunks) FILTER (split = 'test'), 0) AS BIGINT) AS test FROM ({REGISTRY['prepare_corpus'][1]}) pc""")

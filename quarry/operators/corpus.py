"""Corpus preparation: normalise, validate, dedup, filter, balance, chunk, split.

All operators are DataFrame -> DataFrame and stay in built-in expressions.
Sampling and splitting order rows by ``sha2(seed || key)`` so results are
deterministic, independent of partitioning, and reproducible in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..sources.fixed import INGEST_EXTENSIONS, MAX_FILE_SIZE, SKIP_DIRS, TEST_CATEGORIES, TRAIN_CATEGORIES, VAL_CATEGORIES
from .helpers import global_rank, hash_parts

CORPUS_COLS = ["id", "dataset", "language", "code", "label_binary", "label_cwe", "label_cve"]
VALID_LANGUAGES = ["c", "cpp"]


# ---------------------------------------------------------------- P1-P5 adapters
def normalize_language(c) -> Column:
    lang = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(lang.isNull() | (lang == ""), F.lit("unknown")).when(lang == "c++", F.lit("cpp")).otherwise(lang)


def _first_of_list_or_scalar(c: str) -> Column:
    """cwe field that may be a JSON list or a scalar string (stored as text)."""
    col = F.col(c)
    as_list = F.from_json(col, "array<string>")
    return F.when(F.trim(col).startswith("["), F.get(as_list, 0)).otherwise(F.nullif(col, F.lit("")))


def normalize_zenodo(raw: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Bool label, language map, C/C++ only; id from the raw index."""
    code = TX.strip_ws(F.coalesce(F.col("vul_code"), F.lit("")))
    lang = normalize_language("programming_language")
    return (
        raw.select(F.col(ordinal), code.alias("code"), lang.alias("language"),
                   F.coalesce(F.col("is_vulnerable"), F.lit(False)).alias("_v"), "cwe_id", "cve_id")
        .filter(F.col("code") != "")
        .filter(F.col("language").isin(*VALID_LANGUAGES))
        .select(
            F.concat(F.lit("zenodo_"), F.col(ordinal).cast("string")).alias("id"),
            F.lit("zenodo").alias("dataset"), "language", "code",
            F.col("_v").cast("int").alias("label_binary"),
            F.nullif(F.col("cwe_id"), F.lit("")).alias("label_cwe"),
            F.nullif(F.col("cve_id"), F.lit("")).alias("label_cve"),
        )
    )


def normalize_devign(raw: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Fixed language, int label (null -> 0), id from commit_id else index."""
    code = TX.strip_ws(F.col("func"))
    return (
        raw.filter(F.col("func").isNotNull())
        .select(F.col(ordinal), code.alias("code"), "commit_id", "target")
        .filter(F.col("code") != "")
        .select(
            F.concat(F.lit("devign_"), F.coalesce(F.col("commit_id"), F.col(ordinal).cast("string"))).alias("id"),
            F.lit("devign").alias("dataset"), F.lit("c").alias("language"), "code",
            F.coalesce(F.col("target").cast("int"), F.lit(0)).alias("label_binary"),
            F.lit(None).cast("string").alias("label_cwe"),
            F.lit(None).cast("string").alias("label_cve"),
        )
    )


def normalize_diversevul(raw: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """First CWE of list, CVE from message; id counts accepted rows."""
    code = TX.strip_ws(F.coalesce(F.col("func"), F.lit("")))
    kept = (
        raw.select(F.col(ordinal), code.alias("code"), "target", "cwe", "message")
        .filter(F.col("code") != "")
    )
    # rank a narrow projection (the persisted scan stays small), then join the ids back
    ids = global_rank(kept.select(ordinal), [ordinal], out_col="_acc")
    kept = kept.join(ids, ordinal)
    return kept.select(
        F.concat(F.lit("diversevul_"), (F.col("_acc") - 1).cast("string")).alias("id"),
        F.lit("diversevul").alias("dataset"), F.lit("c").alias("language"), "code",
        F.coalesce(F.col("target").cast("int"), F.lit(0)).alias("label_binary"),
        _first_of_list_or_scalar("cwe").alias("label_cwe"),
        TX.first_cve(F.col("message")).alias("label_cve"),
    )


def normalize_megavul(raw: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    code = TX.strip_ws(F.coalesce(F.col("func"), F.lit("")))
    return (
        raw.select(F.col(ordinal), code.alias("code"), "is_vul", "cve_id", "cwe_ids")
        .filter(F.col("code") != "")
        .select(
            F.concat(F.lit("megavul_"), F.col(ordinal).cast("string")).alias("id"),
            F.lit("megavul").alias("dataset"), F.lit("c").alias("language"), "code",
            F.coalesce(F.col("is_vul"), F.lit(False)).cast("int").alias("label_binary"),
            _first_of_list_or_scalar("cwe_ids").alias("label_cwe"),
            F.nullif(F.col("cve_id"), F.lit("")).alias("label_cve"),
        )
    )


def labelled_reason(max_chars: int = 100_000) -> Column:
    """Why a labelled file is left out (null: it is kept)."""
    return (F.when(F.col("category").isNull(), F.lit("no_category")).when(F.col("label").isNull(), F.lit("no_label"))
            .when(F.col("content").isNull() | TX.is_blank("content"), F.lit("empty"))
            .when(F.length("content") > max_chars, F.lit("too_long")))


def normalize_labelled(raw: DataFrame, max_chars: int = 100_000, project: str = "suite") -> DataFrame:
    """Labelled file (path, content, category, label) -> {func, target, project, commit_id,
    file_path}: commit_id is the category, file_path the file's name."""
    return raw.filter(labelled_reason(max_chars).isNull()).select(
        F.col("content").alias("func"), F.col("label").cast("int").alias("target"), F.lit(project).alias("project"),
        F.col("category").alias("commit_id"), TX.file_name("path").alias("file_path"))


def skipped_labelled(raw: DataFrame, max_chars: int = 100_000) -> DataFrame:
    """The files that ``normalize_labelled`` leaves out: path, reason."""
    return raw.select("path", labelled_reason(max_chars).alias("reason")).filter(F.col("reason").isNotNull())


def reason_zenodo() -> Column:
    lang = normalize_language("programming_language")
    code = TX.strip_ws(F.coalesce(F.col("vul_code"), F.lit("")))
    return (F.when(code == "", F.lit("skipped_empty_code"))
            .when(~lang.isin(*VALID_LANGUAGES), F.concat(F.lit("skipped_language_"), lang)).otherwise(F.lit("success")))


def reason_func(null_is_error: bool = True) -> Column:
    """Datasets B, C and D: a null func fails (``error``), a blank one is skipped."""
    null = F.lit("error") if null_is_error else F.lit("skipped_empty_code")
    return (F.when(F.col("func").isNull(), null)
            .when(TX.is_blank("func"), F.lit("skipped_empty_code")).otherwise(F.lit("success")))


def skip_reasons(raw: DataFrame, reason: Column) -> DataFrame:
    """Accepted and rejected records by reason, in one pass."""
    return raw.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def merge_corpora(*dfs: DataFrame) -> DataFrame:
    out = dfs[0].select(*CORPUS_COLS)
    for d in dfs[1:]:
        out = out.unionByName(d.select(*CORPUS_COLS))
    return out


# ---------------------------------------------------------------- P6-P16 projections
def with_language(df: DataFrame, path_col: str, mapping: dict, out: str = "language") -> DataFrame:
    return df.withColumn(out, TX.map_lookup(TX.extension(path_col), mapping))


def with_path_labels(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Category ``CWE<n>`` from the path; label from the file name.

    ``_bad.``/``_bad_`` -> 1; ``_good.``/``_good_`` -> 0 unless the name also has
    goodG2B / goodB2G / good2 (good-to-bad flows) -> 1; otherwise null.
    """
    name = TX.file_name(path_col)
    cwe = F.regexp_extract(F.col(path_col), r"CWE(\d+)", 1)
    bad = name.contains("_bad.") | name.contains("_bad_")
    good = name.contains("_good.") | name.contains("_good_")
    flow = name.contains("goodG2B") | name.contains("goodB2G") | name.contains("good2")
    label = F.when(bad, F.lit(1)).when(good & flow, F.lit(1)).when(good, F.lit(0))
    return (df.withColumn("category", F.when(cwe != "", F.concat(F.lit("CWE"), cwe)))
            .withColumn("label", label))


def split_category_rows() -> list[tuple[str, str]]:
    """(category, split) as listed: a category may be in two splits."""
    lists = (("train", TRAIN_CATEGORIES), ("val", VAL_CATEGORIES), ("test", TEST_CATEGORIES))
    return sorted({(c, split) for split, cats in lists for c in cats})


def split_categories_common(a: DataFrame, b: DataFrame, category: str = "category") -> DataFrame:
    """Categories that two splits share."""
    return a.select(category).intersect(b.select(category))


def split_map_rows() -> list[tuple[str, str]]:
    """(category, split) with precedence train > val > test, duplicates removed."""
    seen: dict[str, str] = {}
    for split, cats in (("train", TRAIN_CATEGORIES), ("val", VAL_CATEGORIES), ("test", TEST_CATEGORIES)):
        for c in cats:
            seen.setdefault(c, split)
    return sorted(seen.items())


def assign_category_split(df: DataFrame, category: str = "category") -> DataFrame:
    """Category -> split via a broadcast lookup (90 fixed rows); unknown dropped."""
    m = df.sparkSession.createDataFrame(split_map_rows(), f"{category} string, split string")
    return df.join(F.broadcast(m), category, "inner")


def with_uid(df: DataFrame, path="file_path", name="function_name", start="start_line") -> DataFrame:
    return df.withColumn("uid", F.concat_ws("::", F.col(path), F.col(name), F.col(start).cast("string")))


def with_snippet(df: DataFrame, col: str = "code", n: int = 500, out: str = "snippet") -> DataFrame:
    return df.withColumn(out, TX.snippet(col, n))


def clean_code(df: DataFrame, col: str = "code", out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, TX.clean_code(col))


def text_metrics(df: DataFrame, col: str = "code") -> DataFrame:
    """total lines, non-blank lines, chars, average line length (line ends not counted)."""
    lines = F.split(F.col(col), "\n", -1)
    return (
        df.withColumn("total_lines", F.size(lines))
        .withColumn("non_empty_lines", F.size(F.filter(lines, lambda l: ~TX.is_blank(l))))
        .withColumn("n_chars", F.length(col))
        .withColumn("avg_line_length", (F.col("n_chars") - F.col("total_lines") + 1) / F.col("total_lines"))
    )


def to_training_pairs(df: DataFrame, text="code", label="label_binary") -> DataFrame:
    return df.select(F.col(text).alias("text"), F.col(label).alias("label"))


# ---------------------------------------------------------------- F1-F10 filters
def drop_empty(df: DataFrame, col: str = "code") -> DataFrame:
    return df.filter(F.col(col).isNotNull() & ~TX.is_blank(col))


def keep_languages(df: DataFrame, langs: Sequence[str], col: str = "language") -> DataFrame:
    return df.filter(F.col(col).isin(*langs))


def quality_gate(df: DataFrame, col: str = "code", min_chars: int = 50, min_lines: int = 3) -> DataFrame:
    return df.filter((F.length(col) >= min_chars) & (TX.line_count(col) >= min_lines))


def exclude_datasets(df: DataFrame, names: Sequence[str], col: str = "dataset") -> DataFrame:
    return df.filter(~F.col(col).isin(*names))


def source_file_reason(path: str = "rel_path", size: str = "size", max_size: int = MAX_FILE_SIZE) -> Column:
    """Why a file of a source tree is left out: its folder (silently, as the tree is
    walked), its extension (silently), or its size; null for an accepted file."""
    segs = F.split(F.regexp_replace(F.col(path), r"^[a-z]+://[^/]*", ""), "/")
    dirs = F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0)))
    return (F.when(F.exists(dirs, lambda s: s.isin(*SKIP_DIRS)), F.lit("skip_dir"))
            .when(F.exists(dirs, lambda s: s.startswith(".") & (F.length(s) > 1)), F.lit("hidden_dir"))
            .when(~TX.extension(path).isin(*INGEST_EXTENSIONS.keys()), F.lit("extension"))
            .when(F.col(size) > max_size, F.concat(F.lit("too large ("), F.format_number(size, 0), F.lit(" bytes)"))))


SILENT_REASONS = ("skip_dir", "hidden_dir", "extension")


def accepted_files(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Files that the ingestion takes, with their language."""
    ok = files.filter(source_file_reason(path).isNull())
    return ok.withColumn("language", F.coalesce(TX.map_lookup(TX.extension(path), INGEST_EXTENSIONS), F.lit("c")))


def skipped_files(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Source files that it leaves out and reports: path, reason."""
    reason = source_file_reason(path)
    return files.select(F.col(path).alias("path"), reason.alias("reason")).filter(
        F.col("reason").isNotNull() & ~F.col("reason").isin(*SILENT_REASONS))


def function_length(df: DataFrame, col: str = "code", lo: int = 10, hi: int = 5000) -> DataFrame:
    return df.filter((F.length(col) > lo) & (F.length(col) < hi))


# ---------------------------------------------------------------- D1-D4 dedup
def content_hash(df: DataFrame, col: str = "code", out: str = "hash") -> DataFrame:
    return df.withColumn(out, TX.content_hash(col))


def dedup_first(df: DataFrame, key: str = "hash", ordinal: str = "ordinal") -> DataFrame:
    """Keep the lowest-ordinal row per key (first wins).

    ``min_by`` over a struct is a partial (map-side) aggregate: a hot hash is
    reduced in every map task before the shuffle, so no group is collected.
    """
    cols = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(ordinal)).alias("_r"))
    return agg.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def drop_label_conflicts(df: DataFrame, key: str = "hash", label: str = "label_binary") -> DataFrame:
    bad = df.groupBy(key).agg(F.countDistinct(label).alias("_n")).filter(F.col("_n") > 1).select(key)
    return df.join(bad, key, "left_anti")


# ---------------------------------------------------------------- A1-A13 aggregates
def distribution(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """count and % per value of ``col`` (within ``by`` groups; else of all rows, whose number
    is a scalar subquery: the values may be many)."""
    by = list(by)
    g = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else df.select(F.count(F.lit(1))).scalar()
    return g.withColumn("pct", F.round(F.col("n") * 100.0 / total, 6))


def fill_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs.append(F.count(c).alias(f"{c}_filled"))
        aggs.append(F.round(F.count(c) * 100.0 / F.count(F.lit(1)), 6).alias(f"{c}_pct"))
    return df.agg(*aggs)


def class_weights(df: DataFrame, label: str = "label_binary", damp: float = 2.5) -> DataFrame:
    n = F.count(F.lit(1))
    nv = F.count_if(F.col(label) == 1)
    ns = F.count_if(F.col(label) == 0)
    return df.agg(
        n.alias("n"), nv.alias("n_vulnerable"), ns.alias("n_safe"),
        F.round(nv / n, 6).alias("w_safe"),
        F.round(ns / n / F.lit(damp), 6).alias("w_vulnerable"),
    )


def sample_weights(df: DataFrame, label: str = "label_binary", damp: float | None = 2.5) -> DataFrame:
    """Row weight: 1 for safe, n_safe / n_vulnerable (/ damp) for vulnerable."""
    ratio = df.agg((F.count_if(F.col(label) == 0) / F.nullif(F.count_if(F.col(label) == 1), F.lit(0))).alias("_r"))
    r = ratio.scalar()
    w = r / F.lit(damp) if damp else r
    return df.withColumn("weight", F.when(F.col(label) == 1, F.round(w, 6)).otherwise(F.lit(1.0)))


def group_rare(df: DataFrame, col: str, min_count: int = 5, other: str = "other_rare", out: str | None = None) -> DataFrame:
    """Categories with fewer than ``min_count`` rows become ``other``; null stays null.

    Only the rare categories are looked up, so a frequent one meets no row on the
    other side, and a rare one has fewer than ``min_count`` rows."""
    rare = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") < min_count)
    j = df.join(rare, col, "left")
    return j.withColumn(out or col, F.when(F.col("_c").isNotNull(), F.lit(other)).otherwise(F.col(col))).drop("_c")


# ---------------------------------------------------------------- W1-W11 order, sample, split, chunk
def seeded_hash(key, seed: int = 42) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(F.lit(str(seed)), F.lit(":"), k.cast("string")), 256)


def undersample(df: DataFrame, label: str = "label_binary", key: str = "id", ratio: int = 3, seed: int = 42) -> DataFrame:
    """Keep every minority row; keep the first ratio x minority majority rows by seeded
    hash.  The cut comes from counts by hash prefix; only one prefix is ranked."""
    h = df.withColumn("_h", seeded_hash(key, seed))
    n_min = df.agg(F.count_if(F.col(label) == 1).alias("_m")).scalar()
    maj = hash_parts(h.filter(F.col(label) == 0), [], "_h", key, lambda n: [n_min * ratio], "_part")
    maj = maj.filter(F.col("_part") == 0).drop("_part")
    return h.filter(F.col(label) == 1).unionByName(maj).drop("_h")


def oversample(df: DataFrame, weight: str = "weight", key: str = "id", seed: int = 42) -> DataFrame:
    """Expected-count resampling: floor(w) copies plus one more with prob frac(w)."""
    u = F.conv(F.substring(seeded_hash(key, seed), 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))
    copies = F.floor(F.col(weight)).cast("int") + F.when(u < F.col(weight) - F.floor(F.col(weight)), 1).otherwise(0)
    return (df.withColumn("_n", copies).filter(F.col("_n") > 0)
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n"))


def stratified_split(df: DataFrame, strata: Sequence[str], key: str = "id", fracs=(0.8, 0.1, 0.1), seed: int = 42,
                     names=("train", "val", "test")) -> DataFrame:
    """Exact cut points per stratum (null is a stratum) on a seeded-hash rank."""
    h = df.withColumn("_h", seeded_hash(key, seed))

    def cuts(n):
        first = F.floor(n * F.lit(fracs[0]))
        return [first, first + F.floor(n * F.lit(fracs[1]))]

    j = hash_parts(h, strata, "_h", key, cuts, "_part")
    return j.withColumn("split", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("_part") + 1)).drop("_h", "_part")


def hash_bucket_split(df: DataFrame, key: str = "id", fracs=(0.8, 0.1, 0.1), seed: int = 42,
                      names=("train", "val", "test")) -> DataFrame:
    """Scalable default: split by a uniform hash value, no rank at all."""
    u = F.conv(F.substring(seeded_hash(key, seed), 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))
    return df.withColumn(
        "split", F.when(u < fracs[0], names[0]).when(u < fracs[0] + fracs[1], names[1]).otherwise(names[2]))


def category_sample(df: DataFrame, category: str, key: str = "id", target: int = 100, seed: int = 42) -> DataFrame:
    """Per category the first max(10, target // 20) rows by seeded hash, then the first
    ``target`` overall.  Keys are ranked alone (each task keeps the first few of a
    category before the shuffle); the chosen rows join back."""
    per = max(10, target // 20)
    h = df.select(F.col(category).alias("_c"), F.col(key).alias("_k"), seeded_hash(key, seed).alias("_h"))
    first = Window.partitionBy("_c").orderBy("_h", "_k")
    top = h.withColumn("_rk", F.row_number().over(first)).filter(F.col("_rk") <= per)
    top = top.orderBy("_h", "_k").limit(target)
    return df.join(F.broadcast(top.select(F.col("_k").alias(key))), key, "left_semi")  # at most ``target`` keys


def every_nth(df: DataFrame, ordinal: str = "ordinal", n: int = 10) -> DataFrame:
    return df.filter(F.col(ordinal) % n == 0)


def token_windows(df: DataFrame, tokens: str = "tokens", size: int = 510, stride: int = 256) -> DataFrame:
    """Overlapping windows; the last window ends at the end; 0 tokens -> one empty window."""
    n_starts = n_windows(F.size(F.col(tokens)), size, stride)
    starts = F.transform(F.sequence(F.lit(0), n_starts - 1), lambda i: i * stride)
    chunks = F.transform(starts, lambda s: F.slice(F.col(tokens), s + 1, F.lit(size)))
    return df.select("*", F.posexplode(chunks).alias("chunk_idx", "chunk"))


def n_windows(n: Column, size: int = 510, stride: int = 256) -> Column:
    """How many windows ``token_windows`` makes of n tokens."""
    return F.when(n <= size, F.lit(1)).otherwise(F.lit(1) + F.ceil((n - size) / F.lit(stride)).cast("int"))


def chunk_stats(df: DataFrame, tokens: str = "tokens", key: str = "id") -> DataFrame:
    """Records with one window and with more, and all windows, counted on the windows."""
    w = token_windows(df.select(key, tokens), tokens).groupBy(key).agg(F.count(F.lit(1)).alias("k"))
    return w.agg(F.count_if(F.col("k") == 1).alias("single_chunk"), F.count_if(F.col("k") > 1).alias("multi_chunk"),
                 F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("total_chunks"))


def pad_truncate(df: DataFrame, ids: str = "chunk", length: int = 512, pad: int = 0) -> DataFrame:
    cut = F.slice(F.col(ids), 1, length)
    fill = length - F.size(cut)
    return df.withColumn("input_ids", F.concat(cut, F.array_repeat(F.lit(pad), fill))).withColumn(
        "attention_mask", F.concat(F.array_repeat(F.lit(1), F.size(cut)), F.array_repeat(F.lit(0), fill)))


# ---------------------------------------------------------------- A5-A7 validation
REQUIRED_FIELDS = ["id", "dataset", "language", "code", "label_binary", "label_cwe", "label_cve"]


def validate_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Validate raw JSONL lines; the first failing check names the error.

    Order: invalid JSON, missing key (in schema order), code not a non-blank
    string, label not 0/1 (JSON true/false count as 1/0).  A key that is
    present with null is not missing; reading lines as text keeps that
    distinction, which a fixed-schema scan would lose.
    """
    v = F.col(text)
    keys = F.json_object_keys(v)
    missing = F.coalesce(*[F.when(~F.array_contains(keys, f), F.lit(f"missing_field_{f}")) for f in REQUIRED_FIELDS])
    code = F.get_json_object(v, "$.code")
    # kinds of the top-level values; a nested key of the same name doesn't count
    kind = lambda key: F.schema_of_variant(F.try_variant_get(F.try_parse_json(v), f"$.{key}", "variant"))
    code_is_str = F.coalesce(kind("code") == "STRING", F.lit(False))
    raw, is_text = F.get_json_object(v, "$.label_binary"), kind("label_binary") == "STRING"
    label_tok = F.when(is_text, F.concat(F.lit('"'), raw, F.lit('"'))).otherwise(F.coalesce(raw, F.lit("null")))
    label_ok = label_tok.rlike(r"^(?:true|false|[01](?:\.0+)?)$")  # JSON 1.0 equals 1
    label_name = F.when(label_tok == "null", F.lit("None")).otherwise(F.regexp_replace(label_tok, r'^"|"$', ""))
    error = (F.when(keys.isNull(), F.lit("json_decode_error"))
             .when(missing.isNotNull(), missing)
             .when(~code_is_str | (TX.strip_ws(F.coalesce(code, F.lit(""))) == ""), F.lit("empty_code"))
             .when(~label_ok, F.concat(F.lit("invalid_label_"), label_name)))
    lang = F.get_json_object(v, "$.language")
    return lines.select(
        "*", error.alias("error"),
        F.get_json_object(v, "$.dataset").alias("dataset"), lang.alias("language"),
        F.when(label_ok, label_tok.rlike("^[1t]").cast("int")).alias("label"),
        F.when(error.isNull() & ~F.coalesce(lang, F.lit("None")).isin(*VALID_LANGUAGES),
               F.concat(F.lit("unknown_language_"), F.coalesce(lang, F.lit("None")))).alias("warning"),
        F.get_json_object(v, "$.label_cwe").isNull().alias("cwe_empty"),
        F.get_json_object(v, "$.label_cve").isNull().alias("cve_empty"),
    )


def _percent(part: str, whole: str) -> Column:
    """``12.3%``: a share to one digit, halves up, in whole numbers (equal in every engine)."""
    tenths = f"((2000 * ({part}) + {whole}) div (2 * {whole}))"
    return F.expr(f"concat({tenths} div 10, '.', {tenths} % 10, '%')")


def corpus_verdict(validated: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Per group: totals and the list of issues (empty list = safe for training).

    Issues: no valid records; more than 10% invalid; a present class under 2%
    of valid records (checked Safe then Vulnerable); no valid language seen."""
    by = list(by)
    ok = F.col("error").isNull()
    agg = validated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("valid"),
        F.count_if(ok & (F.col("label") == 0)).alias("n_safe"), F.count_if(ok & (F.col("label") == 1)).alias("n_vulnerable"),
        F.count_if(ok & F.col("language").isin(*VALID_LANGUAGES)).alias("n_valid_language"),
        F.count_if(ok & F.col("cwe_empty")).alias("empty_cwe"), F.count_if(ok & F.col("cve_empty")).alias("empty_cve"),
    )
    invalid_pct = (F.col("total") - F.col("valid")) * 100.0 / F.col("total")
    safe_pct = F.col("n_safe") * 100.0 / F.col("valid")
    vul_pct = F.col("n_vulnerable") * 100.0 / F.col("valid")
    issues = F.array_compact(F.array(
        F.when(F.col("valid") == 0, F.lit("No valid records found")),
        F.when((F.col("valid") > 0) & (F.col("valid") < F.col("total")) & (invalid_pct > 10), F.concat(_percent("total - valid", "total"), F.lit(" of records are invalid"))),
        F.when((F.col("valid") > 0) & (F.col("n_safe") > 0) & (safe_pct < 2), F.concat(F.lit("Class imbalance: Safe is only "), _percent("n_safe", "valid"))),
        F.when((F.col("valid") > 0) & (F.col("n_vulnerable") > 0) & (vul_pct < 2), F.concat(F.lit("Class imbalance: Vulnerable is only "), _percent("n_vulnerable", "valid"))),
        F.when(F.col("n_valid_language") == 0, F.lit("No valid languages found")),
    ))
    return agg.select(*by, "total", "valid", F.round(invalid_pct, 6).alias("invalid_pct"), "n_safe", "n_vulnerable",
                      "empty_cwe", "empty_cve", F.array_join(issues, "; ").alias("issues"),
                      (F.size(issues) == 0).alias("is_safe"))


def tokenize(df: DataFrame, col: str = "code", fn=None, out: str = "tokens") -> DataFrame:
    """Default: regex tokens (JVM).  ``fn``: a vectorised pandas Series -> Series
    of lists (e.g. a sub-word tokenizer), run as an Arrow-batched pandas UDF."""
    if fn is None:
        return df.withColumn(out, TX.regex_tokens(col))
    udf = F.pandas_udf(fn, "array<string>")
    return df.withColumn(out, udf(F.col(col)))

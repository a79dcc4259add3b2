"""Column expressions over text/code (JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Comment stripper without escape handling: a quote toggles a literal unless
# inside the other literal kind; comments outside literals are removed.
COMMENT_RE = r"""("[^"]*(?:"|\z)|'[^']*(?:'|\z))|//[^\n]*|/\*[\s\S]*?(?:\*/|\z)"""
CVE_RE = r"CVE-\d{4}-\d{4,5}"


# FIXED VALUES — what Python's str.isspace, str.strip and \\s count as white space, as
# class members for Java and for RE2
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS_RE2 = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ws_normalize(c) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(_c(c), f"[{WS}]+", " "))


def strip_ws(c) -> Column:
    """Python-style strip(): remove leading/trailing whitespace of any kind."""
    return F.regexp_replace(_c(c), rf"\A[{WS}]+|[{WS}]+\z", "")


def is_blank(c) -> Column:
    """Nothing but white space."""
    return _c(c).rlike(rf"\A[{WS}]*\z")


def content_hash(c) -> Column:
    """SHA-256 hex of whitespace-normalised text (comments kept)."""
    return F.sha2(ws_normalize(c), 256)


def strip_comments(c) -> Column:
    return F.regexp_replace(_c(c), COMMENT_RE, "$1")


def clean_code(c) -> Column:
    """Strip comments, then collapse whitespace."""
    return ws_normalize(strip_comments(c))


def newline_count(c) -> Column:
    return F.length(_c(c)) - F.length(F.replace(_c(c), F.lit("\n"), F.lit("")))


def line_count(c) -> Column:
    return newline_count(c) + 1


def snippet(c, n: int = 500) -> Column:
    return F.when(F.length(_c(c)) > n, F.concat(F.substring(_c(c), 1, n), F.lit("..."))).otherwise(_c(c))


def file_name(c) -> Column:
    return F.regexp_extract(_c(c), r"([^/\\]*)$", 1)


def extension(c) -> Column:
    """Lower-cased last extension of the last path segment ('' if none)."""
    return F.lower(F.regexp_extract(file_name(c), r"(\.[^./]+)$", 1))


def first_cve(c) -> Column:
    return F.nullif(F.regexp_extract(_c(c), CVE_RE, 0), F.lit(""))


def map_lookup(c, mapping: dict, default=None) -> Column:
    """Lookup in a literal map (a CASE chain that stays in codegen)."""
    expr = None
    for k, v in mapping.items():
        cond = _c(c) == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default)) if default is not None else expr


def regex_tokens(c, pattern: str = r"\w+|[^\w\s]") -> Column:
    """Default tokenizer: identifiers/numbers and single punctuation marks."""
    return F.regexp_extract_all(_c(c), F.lit(pattern), 0)

"""Repetition rules from a suffix array with longest common prefixes.

The words of a block of documents are one sequence in which every word carries its
document, so no repeat crosses documents.  Prefix doubling sorts the suffixes (only those
still tied are sorted again); the ranks of each level give the longest common prefix of
neighbours.  A word span is a maximal repeat if it is an interval of the LCP array; each
suffix's deepest interval is max(lcp before, lcp after), so the union of these spans is
what all maximal repeats cover.  A document is dropped when they cover too large a part of
its words or when the longest is too long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, map_text, table, word_codes

MIN_REPEAT = 8  # words of the shortest repeat that counts
MAX_COVERED = 0.3  # part of the words
MAX_LONGEST = 200  # words


def suffix_ranks(seq: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rank of every suffix, and the ranks by prefixes of 1, 2, 4, ... items.  Equal
    prefixes share a rank, which is the position of the first of them in sorted order."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    new = np.ones(n, bool)
    new[1:] = seq[order][1:] != seq[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    levels, h = [rank.astype(np.int32)], 1
    tied = _tied(rank)
    while len(tied):
        nxt = np.where(tied + h < n, rank[np.minimum(tied + h, n - 1)], -1)
        a = rank[tied]
        by = np.lexsort((nxt, a))
        tied, a, nxt = tied[by], a[by], nxt[by]
        group = np.ones(len(a), bool)
        group[1:] = a[1:] != a[:-1]
        split = group.copy()
        split[1:] |= nxt[1:] != nxt[:-1]
        at = np.arange(len(a))
        start = np.maximum.accumulate(np.where(group, at, 0))
        sub = np.maximum.accumulate(np.where(split, at, 0))
        rank = rank.copy()
        rank[tied] = a + (sub - start)
        levels.append(rank.astype(np.int32))
        h *= 2
        same = ~split
        same[:-1] |= ~split[1:]
        tied = tied[same]
    return rank, levels


def _tied(rank: np.ndarray) -> np.ndarray:
    counts = np.bincount(rank, minlength=len(rank) + 1)
    return np.flatnonzero(counts[rank] > 1)


def suffix_array_lcp(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and lcp[r] between the suffixes of rank r - 1 and r (lcp[0] = 0)."""
    n = len(seq)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank, levels = suffix_ranks(seq)
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    r = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1  # neighbours that share an item
    i, j, got = sa[r - 1], sa[r], np.zeros(len(r), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        for _ in range(2 if k == len(levels) - 1 else 1):
            a, b = i + got, j + got
            ok = (a < n) & (b < n)
            ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
            got[ok] += 1 << k
    lcp[r] = got
    return sa, lcp


def _longer(deep: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeats of ``min_len`` and more, the mask of what they cover, and the union's left ends."""
    n = len(deep)
    deep = np.where(deep >= min_len, deep, 0)
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(deep)
    edge[at] += 1
    np.subtract.at(edge, at + deep[at], 1)
    covered = np.cumsum(edge[:-1]) > 0
    return deep, covered, np.flatnonzero(covered & ~np.concatenate([[False], covered[:-1]])) if n else at


def repeat_spans(seq: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each position the longest repeat that starts there (0 below ``min_len``), the
    mask of positions that repeats cover, and the positions of left ends of the union."""
    n = len(seq)
    sa, lcp = suffix_array_lcp(seq)
    deep = np.zeros(n, np.int64)
    if n:
        deep[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    return _longer(deep, min_len)


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _sum_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_repetition(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, covered_words, longest_repeat, repeat_spans (word spans of
    the union, end exclusive), kept.

    Null text has no words, so the base rule (under 50 words) fails it.  Repeated rows give
    repeated results; only doc_id and text are read.  Texts are never cut: a text longer
    than a block is a block of its own."""

    def block(part: pa.RecordBatch) -> dict:
        texts = as_bytes(part.column(1))
        n = len(texts)
        lists = [t.split() for t in texts]
        lens = np.fromiter(map(len, lists), np.int64, n)
        off = np.concatenate([[0], np.cumsum(lens)])
        codes, distinct = word_codes([w for x in lists for w in x])
        doc = np.repeat(np.arange(n), lens)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, n))])
        chars = _sum_by(((raw & 0xC0) != 0x80) & ~_BLANK[raw], ends)
        symbols = _sum_by(_SYMBOL[raw], ends)
        dup = []
        for t in texts:
            lines = [x for x in t.split(b"\n") if x.strip()]
            dup.append(len(lines) - len(set(lines)))
        seq = doc * max(1, len(distinct)) + codes
        deep, covered, starts = repeat_spans(seq, 3)
        windows = _sum_by(covered, off)  # of repeats of three words and more: all words in such windows
        deep, covered, starts = _longer(deep, min_repeat)
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, doc, deep)
        n_covered = _sum_by(covered, off)
        stops = np.flatnonzero(covered & ~np.append(covered[1:], False)) + 1 if len(covered) else starts
        spans: list[list] = [[] for _ in range(n)]
        for a, b in zip(starts, stops):
            while a < b:  # the union may touch the next text
                d = doc[a]
                to = min(b, off[d + 1])
                spans[d].append({"start": int(a - off[d]), "end": int(to - off[d])})
                a = to
        base = (lens < 50) | (100 * windows > 50 * lens)
        kept = ~base & (n_covered <= max_covered * lens) & (longest <= max_longest)
        return {"doc_id": part.column(0), "n_words": lens, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": pa.array(dup, pa.int64()), "n_repeat_words": windows, "base_failed": base,
                "covered_words": n_covered, "longest_repeat": longest, "repeat_spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": kept}

    return map_text(docs, [F.col("doc_id").cast("long"), "text"], "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_words long, longest_repeat long, repeat_spans array<struct<start:long,end:long>>, kept boolean", block)


def op1_suffix_repetition(spark, sf_dir: str) -> DataFrame:
    """Repetition verdict of every document."""
    return text_repetition(table(spark, sf_dir, "documents")).drop("repeat_spans")

"""Source divergence audit: which terms a source over-uses, and how far apart sources are.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased: on UTF-8 bytes a
byte table and ``bytes.split()``.  A language keeps the terms found in at least 3 of its
documents.  With V of them and N occurrences, a group (a source of a language, or the whole
language) gives a term ``p = 1 + floor(10^9 (count + 1) / (N + V))``; ``f = floor((p-q)^2 / q)``.

*Terms of a source.*  f grows with the count in the source and falls with the count in the
language, whatever N and V are, and equal values go by UTF-8 order.  So a term that k others
beat or equal in all three (higher source count, lower language count, earlier in UTF-8) is not
among the first k.  Each partition keeps its skyband, the terms that fewer than k others
dominate; skybands are merged (a group's terms over ``SALTS`` tasks, then together), and only
what is left is ranked exactly.

*Pairs of sources.*  A language's terms go into blocks of bounded size.  A block is a matrix
of terms by sources; each task adds up f over its terms for every pair and hands on one number
a pair, so no row per term and pair exists.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, settle, table, text_slices

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Tasks that merge the skybands of one hot group; entries of a pair block; partial counts a task holds.
SALTS, BLOCK, HELD = 4, 200_000, 1_500_000
#: Cells of a dense block (terms by sources) in memory.
CELLS = 1 << 20

_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def _group(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit("")).alias(col)


class _Counts:
    """Occurrences and documents by (lang, source) and term of the texts of a task.  Words have
    codes; documents are counted as sorted numbers, not one by one."""

    def __init__(self):
        self.codes: dict[bytes, int] = defaultdict(count().__next__)
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # group and word, occurrences, documents

    def add(self, groups: list[tuple[str, str]], texts: list[bytes]) -> None:
        lists = [terms(t) for t in texts]
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        words = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(lists)), np.int64, int(lens.sum()))
        group = np.fromiter((self.groups.setdefault(g, len(self.groups)) for g in groups), np.int64, len(groups))
        key, n = np.unique(np.repeat(np.arange(len(lists)), lens) << 32 | words, return_counts=True)
        self._hold(group[key >> 32] << 32 | key & 0xFFFFFFFF, n, np.ones(len(n), np.int64))
        if sum(len(p[0]) for p in self.parts) > 2 * HELD:
            self._hold(*(np.concatenate(x) for x in zip(*self.parts)), alone=True)

    def _hold(self, key: np.ndarray, n: np.ndarray, docs: np.ndarray, alone: bool = False) -> None:
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        part = (key[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first))
        self.parts = [part] if alone else [*self.parts, part]

    def full(self) -> bool:
        return len(self.codes) > HELD // 2 or sum(len(p[0]) for p in self.parts) > HELD

    def rows(self) -> pa.RecordBatch:
        if len(self.parts) > 1:
            self._hold(*(np.concatenate(x) for x in zip(*self.parts)), alone=True)
        key, n, docs = self.parts[0] if self.parts else (np.zeros(0, np.int64),) * 3
        langs, sources = (pa.array([g[i] for g in self.groups], pa.string()) for i in (0, 1))
        words = pa.array(list(self.codes), pa.binary()).cast(pa.string())
        group, word = pa.array(key >> 32), pa.array(key & 0xFFFFFFFF)
        return pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), words.take(word), pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: partial counts of each task (several rows a term)."""

    def run(batches):
        counts = _Counts()
        for part in text_slices(batches, 2):
            counts.add(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist())), as_bytes(part.column(2)))
            if counts.full():
                yield counts.rows()
                counts = _Counts()
        yield counts.rows()

    return docs.select(_group("lang"), _group("source"), F.col("text").cast("string").alias("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, lang_count, entries (source, n): the kept terms.  One exchange by (lang, term)."""
    n = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    n = n.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_count"), F.collect_list(F.struct("source", "n")).alias("entries"))
    return n.filter(F.col("docs") >= min_docs).drop("docs")


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n, lang_n, v, entries: a row for every (lang, source) that occurs."""
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_count").alias("lang_n"), F.sum(F.size("entries")).alias("entries"))
    sources = kept.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("n"))
    groups = docs.select(_group("lang"), _group("source")).distinct()
    return groups.join(sources, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "v", "lang_n", "entries"])


def skyband_rows(levels: list[int], names: list[str], k: int) -> list[bool]:
    """Which terms of one group fewer than k others dominate.  The terms come by falling source
    count, then rising language count (``levels``), then UTF-8, so what dominates a term comes
    before it, and only those that stay need be counted (k that dominate it include k that stay).

    A tree over the language counts (each node the sum of a range of them, as in a Fenwick tree)
    holds in every node the first k names, by UTF-8, of the terms that stayed there: a term asks
    the nodes of all counts up to its own how many names come before it."""
    place = {x: i + 1 for i, x in enumerate(sorted(set(levels)))}
    n = len(place)
    nodes: list[list[str]] = [[] for _ in range(n + 1)]
    keep = []
    for level, name in zip(levels, names):
        at = i = place[level]
        before = 0
        while i and before < k:
            before += bisect_left(nodes[i], name)
            i &= i - 1
        keep.append(before < k)
        if before < k:
            while at <= n:
                node = nodes[at]
                if len(node) < k:
                    insort(node, name)
                elif name < node[-1]:
                    insort(node, name)
                    node.pop()
                at += at & -at
    return keep


_ENTRIES = ["lang", "source", "term", "count", "lang_count"]


def skyband(entries: DataFrame, k: int) -> DataFrame:
    """The k-skyband of each (lang, source) of each partition of (lang, source, term, count, lang_count)."""

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows of the last group so far

        def settle_group() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            return rows.filter(pa.array(skyband_rows(rows.column(4).to_pylist(), rows.column(2).to_pylist(), k), pa.bool_()))

        key = None
        for b in batches:
            at = 0
            for i, this in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if this != key:
                    if i > at:
                        held.append(b.slice(at, i - at))
                    if held:
                        yield settle_group()
                    key, at = this, i
            if b.num_rows > at:
                held.append(b.slice(at))
        if held:
            yield settle_group()

    order = ["lang", "source", F.desc("count"), "lang_count", "term"]
    return entries.select(*_ENTRIES).sortWithinPartitions(*order).mapInArrow(run, "lang string, source string, term string, count long, lang_count long")


def _p(count: str, n: str) -> Column:
    """1 + floor(10^9 (count + 1) / (n + v)), exact beyond 64 bits."""
    return F.expr(f"1 + (cast({SCALE} as decimal(11,0)) * cast({count} + 1 as decimal(20,0))) div ({n} + v)")


def _ranked(part: DataFrame) -> DataFrame:
    by = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return part.withColumn("rank", F.row_number().over(by))


def overused_terms(kept: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: the first ``top`` kept terms of each source with p > q."""
    n = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = kept.select("lang", "term", "lang_count", F.explode("entries").alias("e")).select("lang", F.col("e.source").alias("source"), "term", F.col("e.n").alias("count"), "lang_count")
    # what dominates a term with p > q has p > q itself
    over = every.join(totals, ["lang", "source"]).filter(_p("count", "n") > _p("lang_count", "lang_n"))
    band = skyband(over, top)
    # a number given outright: work per byte is high, so small partitions are not to be put together
    band = skyband(band.repartition(n, "lang", "source", F.pmod(F.xxhash64("term"), F.lit(SALTS))), top)
    band = skyband(band.repartition(n, "lang", "source"), top)
    f = band.join(totals, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), _p("count", "n").alias("p"), _p("lang_count", "lang_n").alias("q"))
    f = f.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    return _ranked(f).filter(F.col("rank") <= top)


def _shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 counts / totals) with counts <= totals < 9e15, by long division in base 1000."""
    out, rest = np.zeros_like(counts), counts
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // totals
        rest = rest % totals
    return out + 1


def pair_sums(rows: pa.Array, n_sources: int, codes: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """[a, b]: sum over terms of f with p of source a and q of source b.  ``rows``: the number
    of entries of each term; ``codes``, ``counts``: source and count of each entry."""
    ends = np.concatenate([[0], np.cumsum(rows)]).astype(np.int64)
    out = np.zeros((n_sources, n_sources), np.int64)
    step = max(1, CELLS // n_sources)
    for at in range(0, len(rows), step):
        to = min(len(rows), at + step)
        dense = np.ones((to - at, n_sources), np.int64)
        inside = slice(ends[at], ends[to])
        dense[np.repeat(np.arange(to - at), rows[at:to]), codes[inside]] += counts[inside]
        p = np.ascontiguousarray(_shares(dense, totals).T).astype(np.uint64)
        sums, squares = p.sum(axis=1).astype(np.int64), p * p
        for b in range(n_sources):  # floor((p - q)^2 / q) = floor(p^2 / q) - 2 p + q
            out[:, b] += (squares // p[b]).sum(axis=1).astype(np.int64) - 2 * sums + sums[b]
    return out


def source_pairs(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: every other source of the language, most distant first."""
    size = totals.groupBy("lang").agg(F.max("entries").alias("entries"), F.count(F.lit(1)).alias("s"))
    # a block has as many entries as pairs at least, so blocks hand on no more rows than there are entries and pairs
    size = size.select("lang", F.greatest(F.lit(1), F.ceil(F.col("entries") / F.greatest(F.lit(BLOCK), F.col("s") * F.col("s")))).cast("int").alias("blocks"))
    left = kept.join(size, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "entries")
    right = totals.join(size, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", (F.col("n") + F.col("v")).alias("total"))

    def block(key: tuple, terms: pa.Table, groups: pa.Table) -> pa.Table:
        names = groups.column("source").to_pylist()
        s = len(names)
        sums = np.zeros((s, s), np.int64)
        if terms.num_rows:
            lists = terms.column("entries").combine_chunks()
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            flat = lists.flatten()
            place = {x: i for i, x in enumerate(names)}
            codes = np.fromiter((place[x] for x in flat.field(0).to_pylist()), np.int64, len(flat))
            rows = np.diff(lists.offsets.to_numpy())
            sums = pair_sums(rows, s, codes, flat.field(1).to_numpy(), groups.column("total").to_numpy())
        a, b = np.nonzero(~np.eye(s, dtype=bool))
        return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "source": pa.array([names[i] for i in a], pa.string()), "item": pa.array([names[i] for i in b], pa.string()), "value": pa.array(sums[a, b], pa.int64())})

    parts = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(block, "lang string, source string, item string, value long")
    return _ranked(parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))


def divergence_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank of a table with text, lang, source.

    Null text, lang or source is ''.  A repeated row is a document of its own.  A group without
    kept terms has pairs of value 0 and no term; a language with one source has no pair; an
    empty table gives an empty one.  Other columns are not read."""
    kept = settle(kept_terms(docs, min_docs), "divergence-terms")
    totals = settle(group_totals(docs, kept), "divergence-groups")
    cols = ["lang", "source", "part", "item", "value", "rank"]
    pairs = source_pairs(kept, totals).withColumn("part", F.lit("pair"))
    return pairs.select(*cols).unionByName(overused_terms(kept, totals, top).withColumn("part", F.lit("term")).select(*cols))


def op13_dominance_skyband(spark, sf_dir: str) -> DataFrame:
    """Over-used terms of every source of a language (skyband, then exact ranks), and the
    divergence of every pair of sources."""
    return divergence_audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT rid, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
      FROM (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM d)),
kept AS (SELECT lang, term, count(*) AS lc FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
gc AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, sum(c) AS n FROM gc GROUP BY lang, source),
ln AS (SELECT lang, count(*) AS v, sum(lc) AS n FROM kept GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(gc.c, 0) AS c,
             1 + (1000000000::HUGEINT * (coalesce(gc.c, 0) + 1)) // (coalesce(gn.n, 0) + ln.v)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (k.lc + 1)) // (ln.n + ln.v)::HUGEINT AS q
      FROM g JOIN kept k USING (lang) JOIN ln USING (lang)
      LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source
      LEFT JOIN gc ON gc.lang = g.lang AND gc.source = g.source AND gc.term = k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

"""Filter interaction audit over sorted posting lists.

Five filters judge every document (words are maximal ``[^\\x20\\x09-\\x0D]+``):
A under 50 words; B under 65 distinct words in 100; C over 5 capitals A-Z in 100 code points;
D any of ``#$%&*|``; E a text that a smaller doc_id has too, anywhere in the table.

What a filter fails is a posting list: the sorted ids of a part (a source).  The lists, and
those of good and toxic labels, are dealt out by ranges of ids; a range holds all lists of its
ids, so what the filters share is found inside it.  One k-way merge per list walks the others
beside it, galloping (doubling steps, then a search in what is left) from one block of ids to
the next; it tells for each id which other lists hold it, hence the size of the list without
the union of any of them.  Sizes are summed over ranges.  The 120 orders are then arithmetic on
80 sizes a part: a filter's yield depends on which filters came before it, not on their order.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, hot_join, map_text, settle, table

FILTERS = "ABCDE"
#: Postings of an id range held at a time; ids of a merge step.
RANGE, STEP = 1 << 17, 512
GOOD, TOXIC = 5, 6


def _counts(text: bytes) -> tuple[int, int]:
    words = text.split()
    return len(words), len(set(words))


def base_flags(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, part, fails (bits of A to D), digest of the text; one scan, no shuffle."""

    def block(part: pa.RecordBatch) -> dict:
        texts = part.column(1).fill_null("")
        raw = as_bytes(texts)
        words = np.array([_counts(t) for t in raw], np.int64).reshape(-1, 2)
        capitals = pc.count_substring_regex(texts, "[A-Z]").to_numpy(zero_copy_only=False)
        points = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        marks = pc.match_substring_regex(texts, "[#$%&*|]").to_numpy(zero_copy_only=False)
        fails = (words[:, 0] < 50) + 2 * (100 * words[:, 1] < 65 * words[:, 0]) + 4 * (100 * capitals.astype(np.int64) > 5 * points) + 8 * marks
        return {"doc_id": part.column(0), "part": part.column(2).fill_null(""), "fails": pa.array(fails, pa.int32()), "digest": pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary())}

    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")]
    return map_text(docs, cols, "doc_id long, part string, fails int, digest binary", block).withColumn("row_id", F.monotonically_increasing_id())


def filter_flags(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, part, fails (bits of A to E) for every row of ``docs``.  Only digests
    shared by several rows are looked up, the most frequent ones without a shuffle by key."""
    flags = settle(base_flags(docs), "audit-flags")
    shared = flags.filter(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    joined = hot_join(flags, settle(shared, "audit-copies"), "digest", [F.col("row_id")], "first", "n")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * 16
    return settle(joined.select("row_id", "doc_id", "part", (F.col("fails") + copy).alias("fails")), "audit-fails")


def posting_lists(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """list (0 to 4: filter, 5: good, 6: toxic), part, doc_id, row_id: one row per posting, dealt
    out by ranges of doc_id and sorted.  Label lists hold for all parts (row_id -1)."""
    bits = F.filter(F.array(*[F.when(F.col("fails").bitwiseAND(1 << i) > 0, F.lit(i)) for i in range(5)]), lambda x: x.isNotNull())
    failing = flags.filter("fails > 0").select(F.explode(bits).alias("list"), "part", "doc_id", "row_id")
    marks = F.array(F.when(F.col("quality") == 1, F.lit(GOOD)), F.when(F.col("toxic") == 1, F.lit(TOXIC)))
    marked = labels.filter("doc_id is not null").select(F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("list"), F.lit("").alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(-1).cast("long").alias("row_id"))
    return failing.unionByName(marked).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "row_id", "list")


def gallop(y: np.ndarray, at: int, value, side: str = "left") -> int:
    """Place of ``value`` in sorted ``y`` from ``at`` on: steps double until they pass it."""
    step, n = 1, len(y)
    while at + step < n and (y[at + step] < value or side == "right" and y[at + step] == value):
        at, step = at + step, step * 2
    return at + int(np.searchsorted(y[at : at + step + 1], value, side))


def merge(x: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """For each id of sorted ``x`` the lists that hold it (bit k: ``lists[k]``), in one k-way
    walk: every list gallops to the first and last id of the next step of ``x``."""
    held = np.zeros(len(x), np.int64)
    at = [0] * len(lists)
    for b in range(0, len(x), STEP):
        xs = x[b : b + STEP]
        for k, y in enumerate(lists):
            at[k] = gallop(y, at[k], xs[0])
            window = y[at[k] : gallop(y, at[k], xs[-1], "right")]
            if len(window):
                i = np.minimum(np.searchsorted(window, xs), len(window) - 1)
                held[b : b + STEP] |= (window[i] == xs).astype(np.int64) << k
    return held


def _before(x: int) -> list[int]:
    """Sets of filters (bits) that can come before filter ``x``."""
    return [s for s in range(32) if not s >> x & 1]


def range_sizes(lists: list[np.ndarray], ids: np.ndarray, known: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """[filter, set before it, (all, good, toxic)]: sizes of a filter's list without the union
    of the lists in the set.  ``lists`` are places in ``ids``, the sorted doc_ids of a range."""
    out = np.zeros((5, 32, 3), np.int64)
    for x, mine in enumerate(lists):
        if not len(mine):
            continue
        held = merge(mine, lists)
        label = merge(ids[mine], [good, toxic]) * known[mine]
        for s in _before(x):
            rest = label[(held & s) == 0]
            out[x, s] = len(rest), np.count_nonzero(rest & 1), np.count_nonzero(rest & 2)
    return out


def difference_sizes(postings: DataFrame) -> DataFrame:
    """part, filter, before, removed, good, toxic: partial sums, one set of rows per part and task."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        rest: pa.Table | None = None

        def settle_range(t: pa.Table) -> None:
            which, row = (t.column(c).to_numpy() for c in ("list", "row_id"))
            known = t.column("doc_id").is_valid().to_numpy()
            doc = t.column("doc_id").fill_null(0).to_numpy()
            new = np.ones(len(row), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (known[1:] != known[:-1])
            place = np.cumsum(new) - 1
            ids, known_ids = doc[new], known[new].astype(np.int64)
            good, toxic = doc[which == GOOD], doc[which == TOXIC]
            codes, parts = pd.factorize(t.column("part").to_pandas())
            key = np.where(which < 5, codes * 5 + which, -1)
            order = np.argsort(key, kind="stable")
            ends = np.searchsorted(key[order], np.arange(len(parts) * 5 + 1))
            places = place[order]
            for p, name in enumerate(parts):
                if ends[p * 5] < ends[p * 5 + 5]:
                    lists = [places[ends[p * 5 + f] : ends[p * 5 + f + 1]] for f in range(5)]
                    sizes = range_sizes(lists, ids, known_ids, good, toxic)
                    total[name] = total[name] + sizes if name in total else sizes

        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            if rest.num_rows >= RANGE:
                doc, row = (rest.column(c).to_pylist() for c in ("doc_id", "row_id"))
                cut = len(row) - 1
                while cut and (doc[cut], row[cut]) == (doc[cut - 1], row[cut - 1]):
                    cut -= 1
                if not cut:
                    continue
                settle_range(rest.slice(0, cut))
                # a doc_id that goes on in the next range takes its labels along
                back = cut
                while back and doc[back - 1] == doc[cut]:
                    back -= 1
                labels = rest.slice(back, cut - back)
                rest = pa.concat_tables([labels.filter(pc.greater_equal(labels.column("list"), GOOD)), rest.slice(cut)]).combine_chunks()
        if rest is not None and rest.num_rows:
            settle_range(rest)
        rows = [(name, x, s, *map(int, sizes[x, s])) for name, sizes in total.items() for x in range(5) for s in _before(x) if sizes[x, s].any()]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["part", "filter", "before", "removed", "good", "toxic"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return postings.select("list", "part", "doc_id", "row_id").mapInArrow(run, "part string, filter int, before int, removed long, good long, toxic long")


def filter_orders(spark: SparkSession) -> DataFrame:
    """filter_order, step, filter, before: 600 rows."""
    rows = [("".join(FILTERS[i] for i in p), k + 1, p[k], sum(1 << i for i in p[:k])) for p in permutations(range(5)) for k in range(5)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int")


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley of documents (doc_id, text, source) and labels (doc_id, quality, toxic).

    Null text is empty, null source the part ''.  A row is a document: rows that share a doc_id
    count one by one, and none is a copy of another.  A null doc_id has no label, is no copy and
    has none.  A doc_id is good (toxic) if any of its labels says so.  Empty documents give no
    row; other columns are not read."""
    spark = docs.sparkSession
    flags = filter_flags(docs)
    sizes = difference_sizes(posting_lists(flags, labels)).groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in ("removed", "good", "toxic")])
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("filter"), F.lit(s).alias("before")) for x in range(5) for s in _before(x)]))
    parts = flags.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    grid = parts.withColumn("cell", cells).select("part", "n", "cell.filter", "cell.before").join(sizes, ["part", "filter", "before"], "left").na.fill(0, ["removed", "good", "toxic"])
    one = W.partitionBy("part", "filter")
    # without any other filter a filter removes most, after all others least: its unique fails
    grid = grid.repartition("part").withColumn("fails", F.max("removed").over(one)).withColumn("unique_fails", F.min("removed").over(one))
    steps = grid.join(F.broadcast(filter_orders(spark)), ["filter", "before"])
    gone = F.sum("removed").over(W.partitionBy("part", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    return steps.select(
        "part", "filter_order", "step", (F.col("n") - gone).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails",
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("removed").over(one).alias("shapley"),
    )


def op11_posting_list_audit(spark, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders over every document, by part."""
    return interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT part,
             (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
             + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
             + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask,
             coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good,
             coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS toxic FROM d),
h AS (SELECT part, mask, count(*) AS n, count_if(good) AS g, count_if(toxic) AS x FROM f GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT l1.c || l2.c || l3.c || l4.c || l5.c AS filter_order, [l1.b, l2.b, l3.b, l4.b, l5.b] AS bits
      FROM l l1, l l2, l l3, l l4, l l5
      WHERE l1.b + l2.b + l3.b + l4.b + l5.b = 31 AND (l1.b | l2.b | l3.b | l4.b | l5.b) = 31),
s AS (SELECT filter_order, step, bits[step] AS b, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT h.part, s.filter_order, s.step, any_value(s.b) AS b,
             coalesce(sum(n) FILTER ((mask & (before + b)) = 0), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER ((mask & b) > 0 AND (mask & before) = 0), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER ((mask & b) > 0 AND (mask & before) > 0), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (mask = b), 0)::BIGINT AS unique_fails,
             coalesce(sum(g) FILTER ((mask & b) > 0 AND (mask & before) = 0), 0)::BIGINT AS good_lost,
             coalesce(sum(x) FILTER ((mask & b) > 0 AND (mask & before) = 0), 0)::BIGINT AS toxic_lost
      FROM h, s GROUP BY h.part, s.filter_order, s.step)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley
FROM r
"""

"""N-gram Jaccard join with R-trees of count vectors.

A document is the set of its five-word shingles; two link at a Jaccard similarity of 0.8.

1. Documents with equal sets are one class, represented by its smallest doc_id.
2. Blocks: in one fixed order of all shingles (frequent ones of a bounded sample last, else
   by hash), sets that link share a shingle among their first n - ceil(0.8 n) + 1.  Such a
   shingle held by two or more representatives is a block.  The order decides only the work.
3. Shingles are hashed into groups; a representative's group counts are a point.  The overlap
   of two sets is at most the sum of the smaller coordinates, and of a set and a tree node at
   most that with the node's largest coordinates, so whole nodes are left out.  In a block,
   every point asks an R-tree of the block's first points (a block up to that size: all of
   it, each pair once).
4. Surviving pairs are verified on the exact sets.  A document's text goes once to the group
   of its smallest partner; groups with many documents are salted.  Components are wanted,
   so a pair that verified links of its group join already needs no verification.
5. Blocks with more points than a tree has left the pairs among the rest open.  Only those of
   different components can matter: the block's rest is dealt into trees of bounded size by a
   hash, and the points outside its commonest component ask all of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, hash_share, hash_words, hot_join, mix, settle, shingle_hashes, table, text_slices, word_codes, word_lists
from quarry.llm.components import connected_components

K = 5
#: Points of a leaf and children of a node; points of a block's first tree, and of a tree of its rest.
FANOUT, FIRST, REST = 16, 32, 1024
#: The sample for the shingle order, and the frequent shingles kept of it.
SAMPLE_ROWS, FREQUENT = 10_000, 100_000
#: Documents whose sets a verifying group holds beside their partners.
GROUP = 128
#: Bits of the filter that keeps texts without a surviving pair at home (8 MB).
FILTER_BITS = 1 << 26

# --- sets ---------------------------------------------------------------------------------


def text_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, off = word_lists(texts)
    codes, distinct = word_codes(words)
    h, at = shingle_hashes(codes, hash_words(distinct), off, K)
    return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:])]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 80 * union, of sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def is_frequent(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    at = np.searchsorted(frequent, s)
    out = np.zeros(len(s), bool)
    inside = at < len(frequent)
    out[inside] = frequent[at[inside]] == s[inside]
    return out


def prefix(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the global order (``common``: its frequent ones)."""
    n = len(s)
    return s[np.lexsort((mix(s), common))[: n - (4 * n + 4) // 5 + 1]] if n else s


def count_vector(s: np.ndarray, load: int = 4) -> np.ndarray:
    """Group counts in bytes: ``load`` to twice as many shingles a group; more groups if a
    byte overflows."""
    groups = max(16, 1 << max(0, (len(s) // load).bit_length() - 1))
    h = mix(s ^ np.uint64(0x5851F42D4C957F2D))
    while True:
        v = np.bincount((h & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if v.max(initial=0) <= 255:
            return v.astype(np.uint8)
        groups *= 2


def fold(v: np.ndarray, groups: int) -> np.ndarray:
    """Rows of counts over fewer groups (groups are the low bits of a hash)."""
    if v.shape[1] == groups:
        return v
    return v.reshape(len(v), -1, groups).sum(1, dtype=np.int32)


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that many documents of a bounded sample share: at most FREQUENT, for the order."""
    total = docs.count()
    drawn = docs.filter(hash_share(min(1.0, SAMPLE_ROWS / max(1, total)), seed=21))
    least = max(3, min(total, SAMPLE_ROWS) // 2000)

    def shingles(batches):
        for part in text_slices(batches, 0):
            sets = text_sets(as_bytes(part.column(0)))
            h, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    counts = drawn.select("text").mapInArrow(shingles, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rows = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64))


def document_sets(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, n, sig (of the set), keys (the prefix), its point (vec, and in more groups
    wide), and core, the share of its shingles that are frequent: of near copies of a text
    those with few changes have most."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for part in text_slices(batches):
            sets = text_sets(as_bytes(part.column(1)))
            common = [is_frequent(s, shared.value) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([prefix(s, c).tobytes() for s, c in zip(sets, common)], pa.binary()),
                    pa.array([count_vector(s).tobytes() for s in sets], pa.binary()),
                    pa.array([count_vector(s, 1).tobytes() for s in sets], pa.binary()),
                    pa.array([float(c.mean()) if len(c) else 0.0 for c in common]),
                ],
                ["doc_id", "n", "sig", "keys", "vec", "wide", "core"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig binary, keys binary, vec binary, wide binary, core double")


# --- blocks -------------------------------------------------------------------------------


def blocks(reps: DataFrame) -> DataFrame:
    """(key, doc) of every prefix shingle, for representatives that share it with another
    one whose size can link (the next smaller or larger set in the block)."""

    def explode(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys = part.column(1).to_pylist()
                times = np.fromiter((len(k) // 8 for k in keys), np.int64, len(keys))
                doc, n = (np.repeat(part.column(i).to_numpy(), times) for i in (0, 2))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(keys), np.int64)), pa.array(doc), pa.array(n)], ["key", "doc", "n"])

    def shared_only(batches):
        held = [np.zeros(0, np.int64)] * 3  # the last row so far, if it isn't told yet
        before = None  # key and size of the last row
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, n = (np.append(h, batch.column(i).to_numpy()) for i, h in enumerate(held))
            near = (key[1:] == key[:-1]) & (10 * n[:-1] >= 8 * n[1:])
            keep = np.append(near, False)
            keep[1:] |= near
            if not len(held[0]) and before is not None:
                keep[0] |= key[0] == before[0] and 10 * before[1] >= 8 * n[0]
            before = (key[-1], n[-1])
            held = [x[-1:] if not keep[-1] else x[:0] for x in (key, doc, n)]
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(doc[keep])], ["key", "doc"])

    rows = reps.select("doc_id", "keys", "n").mapInArrow(explode, "key long, doc long, n long")
    return rows.repartition("key").sortWithinPartitions("key", "n").mapInArrow(shared_only, "key long, doc long")


# --- R-tree -------------------------------------------------------------------------------


def possible(bound: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether an overlap up to ``bound`` can link sets of n and m (at least) shingles."""
    return 180 * bound >= 80 * (n + m)


class CountTree:
    """Packed R-tree of count vectors of one length; nodes keep the largest coordinates and
    the range of set sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        half = points[:, : points.shape[1] // 2].sum(1, dtype=np.int64)
        slabs = max(1, int(np.sqrt(len(points) / FANOUT)))
        by_size = np.argsort(sizes, kind="stable")
        self.order = np.concatenate([s[np.argsort(half[s], kind="stable")] for s in np.array_split(by_size, slabs)])  # sort-tile
        top, low, high = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(top, low, high)]
        while len(top) > FANOUT:
            cut = np.arange(0, len(top), FANOUT)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))

    def search(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(question, tree point) of all pairs that the bounds leave."""
        ask = np.repeat(np.arange(len(points)), len(self.levels[-1][0]))
        node = np.tile(np.arange(len(self.levels[-1][0])), len(points))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            n = sizes[ask]
            fit = (10 * high[node] >= 8 * n) & (10 * n >= 8 * low[node])
            ask, node = ask[fit], node[fit]
            ok = np.zeros(len(ask), bool)
            step = max(1, (8 << 20) // top.shape[1])
            for i in range(0, len(ask), step):
                a, b = ask[i : i + step], node[i : i + step]
                ok[i : i + step] = possible(np.minimum(points[a], top[b]).sum(1, dtype=np.int64), sizes[a], low[b])
            ask, node = ask[ok], node[ok]
            if depth:
                below = len(self.levels[depth - 1][0])
                ask, node = np.repeat(ask, FANOUT), (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                ask, node = ask[node < below], node[node < below]
        return ask, self.order[node]


class Forest:
    """Trees of points with vectors of several lengths; linked sets' lengths differ by a
    factor of two at most unless a byte overflowed, and all pairs of lengths are asked."""

    def __init__(self, docs: np.ndarray, sizes: np.ndarray, vecs: list[bytes]):
        self.docs, self.sizes = docs, sizes
        self.parts = {}
        lens = np.array([len(v) for v in vecs])
        for g in np.unique(lens):
            at = np.flatnonzero(lens == g)
            self.parts[int(g)] = (at, np.frombuffer(b"".join(vecs[i] for i in at), np.uint8).reshape(-1, g))
        self.trees: dict[tuple[int, int], CountTree] = {}

    def search(self, sizes: np.ndarray, vecs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(question, point of the forest) of all pairs that the bounds leave."""
        lens = np.array([len(v) for v in vecs])
        out = []
        for g in np.unique(lens):
            rows = np.flatnonzero(lens == g)
            q = np.frombuffer(b"".join(vecs[i] for i in rows), np.uint8).reshape(-1, g)
            for f, (at, points) in self.parts.items():
                r = min(int(g), f)
                if (f, r) not in self.trees:
                    self.trees[f, r] = CountTree(fold(points, r), self.sizes[at])
                a, b = self.trees[f, r].search(fold(q, r), sizes[rows])
                out.append((rows[a], at[b]))
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def leaf_pairs(start: np.ndarray, length: np.ndarray, sizes: np.ndarray, vecs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that the bound leaves within blocks that are one leaf, all blocks at a time."""
    left, right = [], []
    for m in np.unique(length):
        i, j = np.triu_indices(int(m), 1)
        s = start[length == m][:, None]
        left.append((s + i).ravel())
        right.append((s + j).ravel())
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    fit = (10 * sizes[a] >= 8 * sizes[b]) & (10 * sizes[b] >= 8 * sizes[a])
    a, b = a[fit], b[fit]
    lens = np.array([len(v) for v in vecs])
    ok = np.zeros(len(a), bool)
    for g, f in {(int(x), int(y)) for x, y in zip(lens[a], lens[b])}:
        at = np.flatnonzero((lens[a] == g) & (lens[b] == f))
        r = min(g, f)
        for i in range(0, len(at), step := max(1, (8 << 20) // max(g, f))):
            part = at[i : i + step]
            x = np.frombuffer(b"".join([vecs[k] for k in a[part]]), np.uint8).reshape(-1, g)
            y = np.frombuffer(b"".join([vecs[k] for k in b[part]]), np.uint8).reshape(-1, f)
            ok[part] = possible(np.minimum(fold(x, r), fold(y, r)).sum(1, dtype=np.int64), sizes[a[part]], sizes[b[part]])
    return a[ok], b[ok]


_FOUND = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Pairs (no key), the smaller doc first, each once."""
    a, b = a[a != b], b[a != b]
    ab = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.nulls(len(ab), pa.int64()), pa.array(ab[:, 0]), pa.array(ab[:, 1])], schema=_FOUND)


def search_blocks(points: DataFrame) -> DataFrame:
    """key, doc, n, vec, core -> (null, a, b): a pair that the bounds leave; (key, doc, null): a
    point that was only asked about the first of its block, which are those with the most
    frequent shingles.  Memory holds one tree and a batch."""

    def run(batches):
        key, docs, sizes, vecs, forest = None, [], [], [], None

        def close():
            """The pairs among the first points of the open block."""
            nonlocal forest
            d, n = np.array(docs, np.int64), np.array(sizes, np.int64)
            forest = Forest(d, n, vecs)
            q, p = forest.search(n, vecs)
            return d[q[q < p]], d[p[q < p]]

        for batch in text_slices(batches, 3, 16 << 20):
            k, d, n = (batch.column(i).to_numpy() for i in range(3))
            v = batch.column(3).to_pylist()
            cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            length = np.diff(np.append(cut, len(k)))
            # a block inside the batch that is one leaf; the first and the last may go on
            small = length <= FANOUT
            small[-1] = False
            if k[0] == key:
                small[0] = False
            a, b = leaf_pairs(cut[small], length[small], n, v)
            left, right = [d[a]], [d[b]]
            rest_key, rest_doc = [], []
            for s, m in zip(cut[~small], length[~small]):
                if k[s] != key:
                    if key is not None and forest is None:
                        x, y = close()
                        left.append(x), right.append(y)
                    key, docs, sizes, vecs, forest = k[s], [], [], [], None
                e = s + m
                if forest is None:
                    room = min(e, s + FIRST - len(docs))
                    docs += d[s:room].tolist()
                    sizes += n[s:room].tolist()
                    vecs += v[s:room]
                    s = room
                    if s < e:
                        x, y = close()
                        left.append(x), right.append(y)
                if s < e:
                    for i in range(s, e, 4096):
                        j = min(e, i + 4096)
                        q, p = forest.search(n[i:j], v[i:j])
                        left.append(d[i:j][q]), right.append(forest.docs[p])
                    rest_key.append(np.full(e - s, k[s])), rest_doc.append(d[s:e])
            yield _found(np.concatenate(left), np.concatenate(right))
            if rest_key:
                rest = np.concatenate(rest_doc)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rest_key)), pa.array(rest), pa.nulls(len(rest), pa.int64())], schema=_FOUND)
        if key is not None and forest is None:
            yield _found(*close())

    ordered = points.repartition("key").sortWithinPartitions("key", F.desc("core"), F.xxhash64("doc"))
    return ordered.select("key", "doc", "n", "vec").mapInArrow(run, "key long, a long, b long")


def near_labels(edges: DataFrame) -> DataFrame:
    """node, label: nodes with one label are in one component; a component may have several
    labels (its edges are nearly stars, so it rarely has)."""
    low = settle(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "join-near")
    return low.join(low.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").select("node", F.coalesce("top", "up").alias("label"))


def search_rest(rest: DataFrame, points: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different components that the bounds leave among the rest of large blocks.

    ``rest`` is (key, doc); documents with one of ``labels`` are in one component."""
    rows = rest.join(labels.select(F.col("node").alias("doc"), "label"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    by_label = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_label.groupBy("key").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    mixed = settle(mixed.select("key", "main", F.ceil(F.col("total") / REST).cast("long").alias("trees")), "join-mixed")
    if mixed.isEmpty():
        return rest.sparkSession.createDataFrame([], "a long, b long")
    open_rows = rows.join(mixed, "key").join(points, "doc")
    tree = F.pmod(F.xxhash64("doc"), F.col("trees"))
    build = open_rows.select("key", tree.alias("tree"), F.lit(0).alias("kind"), "doc", "label", "n", "vec")
    probe = open_rows.filter("label <> main").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1)).alias("tree"), F.lit(1).alias("kind"), "doc", "label", "n", "vec")

    def run(batches):
        at, docs, labs, sizes, vecs, forest = None, [], [], [], [], None
        for batch in text_slices(batches, 6, 16 << 20):
            key, tree_, kind, d, lab, n = (batch.column(i).to_numpy() for i in range(6))
            v = batch.column(6).to_pylist()
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tree_[1:] != tree_[:-1]) | (kind[1:] != kind[:-1])]))
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, e in zip(cut, np.append(cut[1:], len(key))):
                if (key[s], tree_[s]) != at:
                    at, docs, labs, sizes, vecs, forest = (key[s], tree_[s]), [], [], [], [], None
                if kind[s] == 0:
                    docs += d[s:e].tolist()
                    labs += lab[s:e].tolist()
                    sizes += n[s:e].tolist()
                    vecs += v[s:e]
                elif docs:
                    if forest is None:
                        forest, labs_ = Forest(np.array(docs, np.int64), np.array(sizes, np.int64), vecs), np.array(labs, np.int64)
                    for i in range(s, e, 2048):
                        j = min(e, i + 2048)
                        q, p = forest.search(n[i:j], v[i:j])
                        other = lab[i:j][q] != labs_[p]
                        left.append(d[i:j][q[other]]), right.append(forest.docs[p[other]])
            yield _found(np.concatenate(left), np.concatenate(right))

    dealt = build.unionByName(probe).repartition("key", "tree").sortWithinPartitions("key", "tree", "kind")
    return dealt.select("key", "tree", "kind", "doc", "label", "n", "vec").mapInArrow(run, "key long, a long, b long").select("a", "b").distinct()


# --- verification --------------------------------------------------------------------------


def verify(pairs: DataFrame, docs: DataFrame, every: bool = False) -> DataFrame:
    """Edges (a < b) that join the documents that links among the pairs join, and no others.

    Every text goes once to each group that needs it.  A pair whose documents the links of
    its group join already is passed over: it can't change a component.  With ``every`` none
    is, and the edges are the pairs that link."""
    pairs = settle(pairs, "join-pairs")
    lab = pairs.groupBy("b").agg(F.min("a").alias("lab"))
    grouped = pairs.join(lab, "b")
    sizes = lab.groupBy("lab").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("long").alias("salts")).filter("salts > 1")
    grouped = hot_join(grouped, sizes, "lab", [F.col("b")], "salts", "salts")
    grouped = settle(grouped.select("lab", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).alias("salt"), "a", "b"), "join-groups")
    needs = grouped.select("lab", "salt", F.col("a").alias("doc_id")).union(grouped.select("lab", "salt", "b")).distinct()
    # a filter of bounded size leaves most texts without a pair where they are
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    maps = needs.groupBy(F.bitmap_bucket_number(bit + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit + 1)).alias("map")).collect()
    whole = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in maps:  # bucket k, from 1, is of 32,768 bits
        whole[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["map"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(whole)

    def asked(batches):
        for batch in batches:
            b = batch.column(2).to_numpy()
            hit = (shared.value[b >> 3] >> (b & 7).astype(np.uint8)) & 1 != 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["doc_id", "text"]).filter(pa.array(hit))

    texts = docs.select("doc_id", "text", bit.alias("bit")).mapInArrow(asked, "doc_id long, text string").join(needs, "doc_id")
    rows = texts.select("lab", "salt", F.lit(0).alias("kind"), F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = rows.unionByName(grouped.select("lab", "salt", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("string").alias("text")))

    def check(batches):
        at, sets, root = None, {}, {}

        def find(i: int) -> int:
            while (up := root.get(i, i)) != i:
                root[i] = root.get(up, up)
                i = root[i]
            return i

        for batch in text_slices(batches, 5):
            out = []
            held: list[tuple[int, bytes]] = []

            def load():
                for i, s in zip([i for i, _ in held], text_sets([t for _, t in held]) if held else ()):
                    sets.setdefault(i, []).append(s)
                held.clear()

            texts_ = as_bytes(batch.column(5))
            for lab_, salt, kind, a, b, t in zip(*(batch.column(i).to_pylist() for i in range(5)), texts_):
                if (lab_, salt) != at:
                    held.clear()
                    at, sets = (lab_, salt), {}
                    root.clear()
                if kind == 0:
                    held.append((a, t))
                    continue
                if held:
                    load()
                i, j = (a, b) if every else (find(a), find(b))
                if i != j and any(linked(x, y) for x in sets.get(a, ()) for y in sets.get(b, ())):
                    i, j = min(i, j), max(i, j)
                    if not every:
                        root[j] = i
                    out.append((i, j))
            load()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    dealt = rows.repartition("lab", "salt").sortWithinPartitions("lab", "salt", "kind")
    return settle(dealt.mapInArrow(check, "a long, b long"), "join-links")


# --- the join -------------------------------------------------------------------------------


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The columns read of ``docs``, their sets, those that can link, the classes of equal sets,
    and what search_blocks finds among the representatives."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = settle(document_sets(docs, frequent_shingles(docs)), "join-sets")
    usable = sets.filter("n > 0 AND doc_id IS NOT NULL")
    classes = settle(usable.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "join-classes")
    # of rows alike in doc_id one will do: their blocks and points are the same
    reps = usable.select("sig", "doc_id", "n", "keys").join(classes.select("sig", F.col("rep").alias("doc_id")), ["sig", "doc_id"], "left_semi").dropDuplicates(["sig", "doc_id"])
    points = usable.select(F.col("doc_id").alias("doc"), "n", "vec", "core")
    found = settle(search_blocks(blocks(reps).join(points, "doc")), "join-found")
    return docs, sets, usable, classes, found


def shingle_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole join.  Links (a, b) of the representatives of classes, a < b, each once; and
    doc_id, n_links, a row for each row of ``docs``: the other rows that it links with, those
    of its own class included.

    A group of k representatives near each other has up to k(k - 1)/2 links, and all are
    verified.  Rows that share a doc_id must share a text."""
    docs, sets, usable, classes, found = candidates(docs)
    pairs = found.filter("key IS NULL").select("a", "b")
    rest = found.filter("key IS NOT NULL").select("key", F.col("a").alias("doc"))
    if not rest.isEmpty():
        wide = usable.select(F.col("doc_id").alias("doc"), "n", F.col("wide").alias("vec")).dropDuplicates(["doc"])
        alone = docs.sparkSession.createDataFrame([], "node long, label long")  # each document by itself
        pairs = pairs.unionByName(search_rest(rest, wide, alone))
    links = verify(pairs.distinct(), docs, every=True).distinct()
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ends.join(classes.select(F.col("rep").alias("b"), "copies"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("near"))
    counted = classes.join(near, "rep", "left").select("sig", "copies", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    keyed = sets.select("doc_id", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("sig")).alias("sig"))
    joined = hot_join(keyed, counted, "sig", [F.col("doc_id")], "n_links", "copies")
    return links, joined.select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def shingle_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of ``docs``.

    Null or wordless text: an empty set, linked with nothing (its own component).  A row
    without doc_id is linked with nothing and has no component.  Repeated rows are alike.
    Rows that share a doc_id should share a text; if not, each gets the component of its own
    text, and classes with the same smallest doc_id are one.  Other columns are not read."""
    docs, sets, usable, classes, found = candidates(docs)
    links = verify(found.filter("key IS NULL").select("a", "b").distinct(), docs)
    rest = found.filter("key IS NOT NULL").select("key", F.col("a").alias("doc"))
    if not rest.isEmpty():
        wide = usable.select(F.col("doc_id").alias("doc"), "n", F.col("wide").alias("vec"))
        links = links.unionByName(verify(search_rest(rest, wide, near_labels(links)), docs))
    labels = connected_components(links)
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select("sig", "copies", F.coalesce("label", "rep").alias("component_id"))
    keyed = sets.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("sig")).alias("sig"))
    joined = hot_join(keyed, named, "sig", [F.col("doc_id")], "component_id", "copies")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group, that of the smallest doc_id; all columns.
    Repeated rows are a group; texts without words and rows without doc_id stay."""
    kept = shingle_components(docs).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__id")).distinct()
    named = docs.withColumn("__text", F.xxhash64(F.col("text").cast("string"))).withColumn("__id", F.col("doc_id").cast("long"))
    # the join deals rows out by __id, so the copies of a row are in one place already
    one = named.join(kept, "__id", "left_semi").dropDuplicates(["__id", "__text"])
    return one.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def op5_count_rtree_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return shingle_components(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, label) AS (SELECT doc_id, doc_id FROM n UNION SELECT g.b, r.label FROM r JOIN g ON g.a = r.node)
SELECT n.doc_id, n.n AS n_shingles, m.label AS component_id FROM n JOIN (SELECT node, min(label) AS label FROM r GROUP BY node) m ON m.node = n.doc_id
"""

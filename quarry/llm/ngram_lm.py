"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 holds every training word: hashes as an Elias-Fano list by shards (ranges of the
hash), exact counts, and the quantised back-off weight of the word as a context.  A word's id
is its place in the list.  Level 2 holds every training pair: a shard has its contexts,
Elias-Fano pointers to their successors, and the successors' ids relative to the context
(rank * V + id, monotone), with quantised discounted probabilities.  A pair is looked up from
the context's rank by the range of its pointers, and in that range only.  A context that
holds more than a quarter of an even shard of all tokens is dealt over all shards by the hash
of the next word, so no shard grows with one word.

    p(w | h) = alpha(h, w) + lambda(h) * p1(w)
    alpha = (c(h w) - D) / c(h) for kept pairs; lambda(h) = 1 - sum of alpha(h, .)
    p1(w) = (c + 0.5) / (N + 0.5 * (V + 1)), c = 0 for a word not seen

Shards are files in the shared folder, memory-mapped by the tasks that look things up (read
whole where the folder isn't a mounted one).  What a task keeps of the model is the mapped
pages and one row of metadata a shard.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, crc_mod5, create_file, hash_words, map_text, mix, read_file, settle, table, text_slices, word_codes, word_lists
from quarry.llm.elias_fano import EliasFano, open_arrays, pack_arrays
from quarry.session import shared_path

DISCOUNT, MIN_COUNT = 0.75, 1
SLICE = 8 << 20
#: No word holds a space, so this stands for the end of a text (and what comes before its start).
END = b" end"
#: Eight bits for a log10 from 0 to -12.75: steps of 0.05; 0 is exactly 1.
STEP = 0.05


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) / STEP), 0, 255).astype(np.uint8)


def dequantise(code: np.ndarray) -> np.ndarray:
    return (10.0 ** (-STEP * np.arange(256)))[code]


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Range of the hash: shard s holds hashes from ceil(s * 2^32 / shards) * 2^32 on."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def shard_start(s: int, shards: int) -> int:
    return -(-(s << 32) // shards) << 32


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Codes of the tokens of all texts, each closed by the end token (code 0), the offsets of
    the texts, and the distinct tokens by code."""
    words, off = word_lists(texts)
    codes, distinct = word_codes([END, *words])
    out = np.zeros(len(words) + len(texts), np.int64)
    place = np.arange(len(words)) + np.repeat(np.arange(len(texts)), np.diff(off))
    out[place] = codes[1:]
    return out, off + np.arange(len(off)), distinct


def _blobs(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray, base: int) -> pa.RecordBatch:
    """A row for each shard; the rows are in order of shard."""
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(shard))
    return pa.RecordBatch.from_arrays([pa.array(shard[cut] + base), pa.array([keys[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())], ["shard", "keys", "counts"])


_BLOB = "shard long, keys binary, counts binary"


def _by_shard(batches):
    """(shard, sorted distinct keys, summed counts) of a partition sorted by shard."""
    shard, keys, counts = None, [], []

    def done():
        k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return shard, k[first], np.add.reduceat(c, first)

    for batch in batches:
        for s, k, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if s != shard:
                if keys:
                    yield done()
                shard, keys, counts = s, [], []
            keys.append(np.frombuffer(k, np.uint64))
            counts.append(np.frombuffer(c, np.uint32))
    if keys:
        yield done()


def _write(folder: str, level: int, shard: int, arrays: dict[str, np.ndarray]) -> str:
    path = f"{folder}/level{level}-{shard}-{uuid.uuid4().hex}.ef"
    with create_file(path) as out:
        out.write(pack_arrays(arrays))
    return path


@dataclass
class Model:
    shards: int
    words: list[str | None]  # level 1 files by shard
    first: np.ndarray  # id of the first word of each shard; V at the end
    tokens: int  # N
    pairs: list[str | None] | None = None  # level 2 files by shard
    hot: dict[int, float] | None = None  # back-off weights of the contexts dealt over all shards

    @property
    def vocabulary(self) -> int:
        return int(self.first[-1])

    @property
    def hot_count(self) -> float:
        """A context with more tokens is dealt over all shards."""
        return max(1000.0, self.tokens / (4 * self.shards))


class Reader:
    """Looks words and pairs up in mapped shards."""

    def __init__(self, model: Model):
        self.m, self.open = model, {}

    def arrays(self, path: str) -> dict:
        if path not in self.open:
            self.open[path] = open_arrays(read_file(path))
        return self.open[path]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id (-1: not seen), count and back-off code of each word."""
        n = len(hashes)
        ids, counts, codes = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.uint8)
        order = np.argsort(hashes, kind="stable")
        shard = shard_of(hashes[order], self.m.shards)
        for s in np.unique(shard):
            if (path := self.m.words[s]) is None:
                continue
            at = order[np.searchsorted(shard, s) : np.searchsorted(shard, s, side="right")]
            a = self.arrays(path)
            i, hit = EliasFano.of(a, "hash").successor(hashes[at] - np.uint64(shard_start(int(s), self.m.shards)))
            at, i = at[hit], i[hit]
            ids[at], counts[at] = self.m.first[s] + i, a["counts"][i]
            if self.m.pairs is not None and (p := self.m.pairs[s]) is not None:
                codes[at] = self.arrays(p)["lambda"][i]
        return ids, counts, codes

    def pair_shard(self, ctx: np.ndarray, nxt: np.ndarray, ctx_count: np.ndarray) -> np.ndarray:
        own = np.searchsorted(self.m.first, ctx, side="right") - 1
        return np.where(ctx_count > self.m.hot_count, (mix(nxt.astype(np.uint64) + np.uint64(9)) % np.uint64(self.m.shards)).astype(np.int64), own)

    def pairs(self, ctx: np.ndarray, nxt: np.ndarray, ctx_count: np.ndarray) -> np.ndarray:
        """alpha of each pair, 0 if it isn't kept."""
        out = np.zeros(len(ctx))
        shard = self.pair_shard(ctx, nxt, ctx_count)
        order = np.argsort(shard, kind="stable")
        sorted_ = shard[order]
        for s in np.unique(sorted_):
            if (path := self.m.pairs[s]) is None:
                continue
            a = self.arrays(path)
            contexts = EliasFano.of(a, "contexts")
            if not contexts.n:
                continue
            at = order[np.searchsorted(sorted_, s) : np.searchsorted(sorted_, s, side="right")]
            rank, hit = contexts.successor(ctx[at])
            at, rank = at[hit], rank[hit]
            pointers = EliasFano.of(a, "pointers")
            first, end = (pointers.access(rank + k).astype(np.int64) for k in (0, 1))
            i, hit = EliasFano.of(a, "successors").successor(rank.astype(np.uint64) * np.uint64(self.m.vocabulary) + nxt[at].astype(np.uint64), first, end)
            out[at[hit]] = dequantise(a["alpha"][i[hit]])
        return out


def count_words(docs: DataFrame, folder: str, shards: int) -> Model:
    def words(batches):
        for part in text_slices(batches, 0, SLICE):
            codes, _, distinct = sequences(as_bytes(part.column(0)))
            h = hash_words(distinct)
            order = np.argsort(h, kind="stable")
            n = np.bincount(codes, minlength=len(distinct)).astype(np.uint32)
            yield _blobs(shard_of(h[order], shards), h[order], n[order], 0)

    def level(batches):
        for s, h, n in _by_shard(batches):
            base = shard_start(s, shards)
            ef = EliasFano.build(h - np.uint64(base), shard_start(s + 1, shards) - base)
            path = _write(folder, 1, s, ef.parts("hash") | {"counts": n.astype(np.uint32) if n.max() < 1 << 32 else n})
            yield pa.RecordBatch.from_pylist([{"shard": s, "words": len(h), "tokens": int(n.sum()), "path": path}])

    blobs = docs.select(F.col("text").cast("string")).mapInArrow(words, _BLOB)
    meta = settle(blobs.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(level, "shard long, words long, tokens long, path string"), "lm-words")
    rows = {r["shard"]: r for r in meta.collect()}  # one row a shard
    sizes = [rows[s]["words"] if s in rows else 0 for s in range(shards)]
    if sum(sizes) >= 1 << 32:
        raise ValueError("more than 2^32 words: ids don't fit")
    return Model(shards, [rows[s]["path"] if s in rows else None for s in range(shards)], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), sum(r["tokens"] for r in rows.values()))


def count_pairs(docs: DataFrame, folder: str, model: Model, min_count: int, discount: float) -> Model:
    spark, shards = docs.sparkSession, model.shards
    shared = spark.sparkContext.broadcast(model)  # a row of metadata a shard

    def pairs(batches):
        reader = Reader(shared.value)
        for part in text_slices(batches, 0, SLICE):
            codes, off, distinct = sequences(as_bytes(part.column(0)))
            ids, counts, _ = reader.words(hash_words(distinct))
            before = np.roll(codes, 1)
            before[off[:-1]] = 0
            # a pair is no more frequent than its words
            keep = (counts[before] >= min_count) & (counts[codes] >= min_count)
            key, n = np.unique(ids[before[keep]].astype(np.uint64) << np.uint64(32) | ids[codes[keep]].astype(np.uint64), return_counts=True)
            ctx = (key >> np.uint64(32)).astype(np.int64)
            known = np.argsort(ids, kind="stable")
            shard = reader.pair_shard(ctx, (key & np.uint64(0xFFFFFFFF)).astype(np.int64), counts[known[np.searchsorted(ids[known], ctx)]])
            order = np.argsort(shard, kind="stable")
            yield _blobs(shard[order], key[order], n[order].astype(np.uint32), 0)

    def level(batches):
        m = shared.value
        reader = Reader(m)
        for s, key, n in _by_shard(batches):
            key, n = key[n >= min_count], n[n >= min_count]
            ctx, nxt = (key >> np.uint64(32)).astype(np.int64), key & np.uint64(0xFFFFFFFF)
            contexts, start = np.unique(ctx, return_index=True)
            # counts of the contexts: of this shard's words, or hot ones, from level 1
            total = np.zeros(len(contexts), np.int64)
            home = np.searchsorted(m.first, contexts, side="right") - 1
            for h in np.unique(home):
                total[home == h] = reader.arrays(m.words[h])["counts"][contexts[home == h] - m.first[h]]
            alpha = (n - discount) / np.repeat(total, np.diff(np.append(start, len(ctx))))
            code = quantise(alpha)
            mass = np.add.reduceat(alpha, start) if len(start) else np.zeros(0)
            hot = total > m.hot_count
            lam = np.zeros(int(m.first[s + 1] - m.first[s]), np.uint8)
            own = (home == s) & ~hot
            lam[contexts[own] - m.first[s]] = np.maximum(1, quantise(1 - mass[own]))  # 0: no successor
            rank = np.repeat(np.arange(len(contexts), dtype=np.uint64), np.diff(np.append(start, len(ctx))))
            arrays = EliasFano.build(contexts.astype(np.uint64), m.vocabulary).parts("contexts")
            arrays |= EliasFano.build(np.append(start, len(ctx)).astype(np.uint64), len(ctx) + 1).parts("pointers")
            arrays |= EliasFano.build(rank * np.uint64(m.vocabulary) + nxt, max(1, len(contexts) * m.vocabulary)).parts("successors")
            path = _write(folder, 2, s, arrays | {"alpha": code, "lambda": lam})
            rows = [{"shard": s, "path": path, "ctx": None, "mass": None}] + [{"shard": s, "path": None, "ctx": int(c), "mass": float(x)} for c, x in zip(contexts[hot], mass[hot])]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.int64()), ("path", pa.string()), ("ctx", pa.int64()), ("mass", pa.float64())]))

    blobs = docs.select(F.col("text").cast("string")).mapInArrow(pairs, _BLOB)
    meta = settle(blobs.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(level, "shard long, path string, ctx long, mass double"), "lm-pairs")
    paths = {r["shard"]: r["path"] for r in meta.filter("path IS NOT NULL").collect()}
    # at most 4 * shards contexts are hot
    hot = {r["ctx"]: max(1e-12, 1 - r["mass"]) for r in meta.filter("ctx IS NOT NULL").groupBy("ctx").agg(F.sum("mass").alias("mass")).collect()}
    model.pairs, model.hot = [paths.get(s) for s in range(shards)], hot
    return model


def train(docs: DataFrame, shards: int | None = None, min_count: int = MIN_COUNT, discount: float = DISCOUNT) -> Model:
    """The trie of all rows of ``docs`` (null text: empty).  ``shards``: as many as the
    session's shuffle partitions, which its owner sets by the size of the data."""
    spark: SparkSession = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = shared_path(spark, "lm")
    return count_pairs(docs, folder, count_words(docs, folder, shards), min_count, discount)


def score(docs: DataFrame, model: Model, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10): a row for
    each row of ``docs``.  Null text is empty: its one token is the end."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made: list[Reader] = []

    def block(part: pa.RecordBatch) -> dict:
        if not made:
            made.append(Reader(shared.value))
        reader, m = made[0], shared.value
        codes, off, distinct = sequences(as_bytes(part.column(1)))
        ids, counts, lam_code = reader.words(hash_words(distinct))
        p1 = (counts + 0.5) / (m.tokens + 0.5 * (m.vocabulary + 1))
        lam = dequantise(lam_code)
        if m.hot:
            for i in np.flatnonzero(counts > m.hot_count):
                lam[i] = m.hot.get(int(ids[i]), 1.0)
        before = np.roll(codes, 1)
        before[off[:-1]] = 0
        p = lam[before] * p1[codes]
        ask = np.flatnonzero((lam[before] < 1) & (counts[codes] > 0))  # else the pair isn't kept
        key, back = np.unique(before[ask] * len(distinct) + codes[ask], return_inverse=True)
        c, w = np.divmod(key, len(distinct))
        p[ask] += reader.pairs(ids[c], ids[w], counts[c])[back]
        logs, base = np.log10(p), np.log10(p1)
        ends = off[1:]
        by = lambda x: np.add.reduceat(x, off[:-1])  # noqa: E731  every text has a token
        return {"doc_id": part.column(0), "held_out": part.column(2), "n_tokens": ends - off[:-1], "n_known": by((counts[codes] > 0).astype(np.int64)), "train_tokens": np.full(part.num_rows, m.tokens), "base_score": by(base[codes]), "score": by(logs)}

    return map_text(docs, [F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out.alias("held_out")], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", block, SLICE)


def op7_elias_fano_lm(spark, sf_dir: str) -> DataFrame:
    """Every document under the model of those whose crc32(doc_id) mod 5 is not 1."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs.filter(crc_mod5() != 1)), crc_mod5() == 1)

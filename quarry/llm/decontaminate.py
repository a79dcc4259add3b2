"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's words over all documents (one pass, one row per
   word and task) give TF-IDF weights; words of no benchmark passage hold nothing of one.
2. A randomised SVD of the TF-IDF matrix of the benchmark passages (rows of length 1): partitions add up
   A'(A X) for a block of vectors X, summed by blocks of words; the driver only does the
   small QR and eigenproblem.
3. Every document is cut into overlapping word windows, which are projected and compared with
   all passages of their length class.  A window is a candidate by the share of the passage's
   own squared length that it holds, so neither the number of documents nor the other words
   of the window change what is found; a window lighter than the passage, also by its cosine
   (the other words weighed as if in one document).  Both are bounded by sums over the
   window's words, and windows under the threshold by these bounds are left out.
4. Candidates are checked by the longest common subsequence of the passage and the words
   around the window, and, unless all of it is there, by the passage's answer: the answer column,
   or else what its words say by weight, so that common words alone are no evidence.
5. Passages under five words have no window of their own: they are found where they stand word
   for word, if they have twelve letters at least.

In scripts that are written without spaces every character is a word.

No shuffle moves texts.  Passages are handled in blocks of bounded size, one pass each.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SLICE_BYTES, as_bytes, filter_texts, map_text, table, text_slices

#: Passages of one block (its words and vectors go to every task), and latent dimensions.
#: Passages have few words in common, so a rank under their number loses some of them.
BLOCK_ITEMS, RANK = 256, 256
COSINE = 0.35
LCS_SHARE = 0.6  # of the passage's words
ANSWER_SHARE = 0.5  # of the weight of its words, or of its answer's words in order
MIN_WORDS = 5  # a shorter passage is searched as it stands
SHORT_CHARS = 12  # with fewer letters it is common speech, and no evidence
WORD_BLOCK = 256


@dataclass
class Passages:
    """A block of benchmark passages."""

    ids: list[int]
    words: list[list[bytes]]
    answers: list[list[bytes]]
    code: dict[bytes, int]
    idf2: np.ndarray = field(default=None)  # squared weight of each word; the last is for all others
    vectors: np.ndarray = field(default=None)  # (words, rank)
    latent: np.ndarray = field(default=None)  # (passages, rank), of length 1
    tier: np.ndarray = field(default=None)  # window length of each passage


#: ASCII punctuation separates words, as marks are often glued to copied passages.
_MARKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


#: Characters of scripts without spaces: Thai and Lao, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def tokens(text: bytes) -> list[bytes]:
    if text.isascii():
        return text.lower().translate(_MARKS).split()
    lower = text.decode("utf-8", "replace").lower()
    if max(lower) >= "\u0e00":
        lower = _UNSPACED.sub(r" \1 ", lower)
    return lower.encode().translate(_MARKS).split()


def searchable(words: list[bytes]) -> bool:
    return len(words) >= MIN_WORDS or len(b"".join(words).decode()) >= SHORT_CHARS


def load_blocks(benchmark: DataFrame, block: int = BLOCK_ITEMS):
    """Passages of five words or twelve letters and more, in blocks by a hash of item_id."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer")).filter("text IS NOT NULL AND item_id IS NOT NULL")
    parts = max(1, -(-items.count() // block))
    for b in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", F.lit(5)), F.lit(parts)) == b).collect()
        rows = sorted((r for r in rows if searchable(tokens(r["text"].encode()))), key=lambda r: (r["item_id"], r["text"]))
        words = [tokens(r["text"].encode()) for r in rows]
        code: dict[bytes, int] = {}
        for x in words:
            for w in x:
                code.setdefault(w, len(code))
        if rows:
            yield Passages([r["item_id"] for r in rows], words, [tokens((r["answer"] or "").encode()) for r in rows], code)


def document_frequencies(docs: DataFrame, code: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Documents that hold each word, and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(code)

    def run(batches):
        known = shared.value
        n, df = 0, np.zeros(len(known), np.int64)
        for part in text_slices(batches, 0, SLICE_BYTES // 2):
            for text in as_bytes(part.column(0)):
                hit = known.keys() & set(tokens(text))
                if hit:
                    df[[known[w] for w in hit]] += 1
            n += part.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["word", "n"])

    out = np.zeros(len(code), np.int64)
    total = 0
    for r in docs.select(F.col("text").cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        if r["word"] < 0:
            total = r["n"]
        else:
            out[r["word"]] = r["n"]
    return out, total


def weights(codes: np.ndarray, idf2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of a passage and their weights sqrt(tf) * idf, so that the squared
    length is the sum of idf squared over its words."""
    count = Counter(codes[codes >= 0].tolist())  # a few dozen words
    u = np.fromiter(count.keys(), np.int64, len(count))
    return u, np.sqrt(np.fromiter(count.values(), np.int64, len(count)) * idf2[u])


def randomised_svd(spark, rows: list[tuple[list[int], list[float]]], n_words: int, rank: int, seed: int = 3, partitions: int = 8) -> np.ndarray:
    """Leading right singular vectors (words, rank) of the matrix with these sparse rows,
    which are dealt over partitions: two rounds of A'(A X), one to find the range from random
    vectors and one to solve in it."""
    rank = min(rank, len(rows), n_words)
    width = min(rank + 16, n_words)
    matrix = spark.createDataFrame([(list(map(int, u)), list(map(float, v))) for u, v in rows], "w array<long>, v array<double>").repartition(partitions)

    def gram(x: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(x)

        def add(batches):
            x_, acc = shared.value, np.zeros((n_words, width))
            for batch in batches:
                for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    u, v = np.array(u, np.int64), np.array(v)
                    acc[u] += v[:, None] * (v @ x_[u])
            for b in range(0, n_words, WORD_BLOCK):
                if acc[b : b + WORD_BLOCK].any():
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([acc[b : b + WORD_BLOCK].tobytes()], pa.binary())], ["b", "m"])

        def total(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for b, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    sums[b] = sums.get(b, 0) + np.frombuffer(m)
            for b, m in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([m.tobytes()], pa.binary())], ["b", "m"])

        out = np.zeros((n_words, width))
        for r in matrix.mapInArrow(add, "b long, m binary").repartition("b").mapInArrow(total, "b long, m binary").collect():
            part = np.frombuffer(bytes(r["m"])).reshape(-1, width)
            out[r["b"] : r["b"] + len(part)] = part
        return out

    q = np.linalg.qr(gram(np.random.default_rng(seed).normal(size=(n_words, width))))[0]
    small = q.T @ gram(q)
    _, u = np.linalg.eigh((small + small.T) / 2)
    return (q @ u[:, ::-1][:, :rank]).astype(np.float32)


def fit(docs: DataFrame, p: Passages, rank: int = RANK) -> Passages:
    df, n = document_frequencies(docs, p.code)
    p.idf2 = np.append(np.log((n + 2) / (df + 1)), np.log((n + 2) / 2)) ** 2
    p.idf2 = np.maximum(p.idf2, 1e-6)
    rows = [weights(np.array([p.code[w] for w in x]), p.idf2) for x in p.words]
    # rows of length 1: a passage of few words counts as much as one of many
    p.vectors = randomised_svd(docs.sparkSession, [(u, v / np.linalg.norm(v)) for u, v in rows], len(p.code), rank)
    z = np.array([v @ p.vectors[u] for u, v in rows])
    p.latent = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    p.tier = np.array([max(16, 1 << (len(x) - 1).bit_length()) if len(x) >= MIN_WORDS else 0 for x in p.words])
    return p


def lcs(masks: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Longest common subsequence of a passage (a bit mask of places by word) and ``words``."""
    full = (1 << n) - 1
    v = full
    for w in words:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full if u else v
    return n - v.bit_count()


def place_masks(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Matcher:
    """Finds the passages of a block in lists of words."""

    def __init__(self, p: Passages, cosine: float, lcs_share: float):
        self.p, self.cosine, self.share = p, cosine, lcs_share
        self.masks = [place_masks(x) for x in p.words]
        self.weight = [{w: float(p.idf2[p.code[w]]) for w in x} for x in p.words]
        # lengths of the passages, and the most of a passage of the tier that a place of each word can hold
        rows = [weights(np.array([p.code[w] for w in x]), p.idf2) for x in p.words]
        self.norm = np.array([np.linalg.norm(v) for _, v in rows])
        self.most = {int(t): np.zeros(len(p.idf2)) for t in np.unique(p.tier)}
        #: Short passages by their first word.
        self.short: dict[int, list[tuple[int, list[int]]]] = {}
        for i in np.flatnonzero(p.tier == 0).tolist():
            at = [p.code[w] for w in p.words[i]]
            self.short.setdefault(at[0], []).append((i, at))
        for t, (u, v), norm in zip(p.tier.tolist(), rows, self.norm):
            self.most[t][u] = np.maximum(self.most[t][u], v * np.sqrt(p.idf2[u]) / norm**2)

    def verify(self, item: int, region: list[bytes]) -> float:
        """Share of the passage in the region, 0 if it isn't the passage."""
        n = len(self.p.words[item])
        got = lcs(self.masks[item], n, region) / n
        if got < self.share:
            return 0.0
        if got == 1:
            return got
        if answer := self.p.answers[item]:
            ok = lcs(place_masks(answer), len(answer), region) >= ANSWER_SHARE * len(answer)
        else:
            weight = self.weight[item]
            ok = sum(weight[w] for w in weight.keys() & set(region)) >= ANSWER_SHARE * sum(weight.values())
        return got if ok else 0.0

    def find(self, texts: list[list[bytes]]) -> list[dict[int, float]]:
        """Passages found in each text, and the share of each."""
        p = self.p
        found: list[dict[int, float]] = [{} for _ in texts]
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        off = np.concatenate([[0], np.cumsum(lens)])
        get = p.code.get
        codes = np.fromiter((get(w, -1) for x in texts for w in x), np.int64, int(off[-1]))
        if self.short:
            for at in np.flatnonzero(np.isin(codes, list(self.short))).tolist():
                d = int(np.searchsorted(off, at, side="right")) - 1
                for item, words in self.short[int(codes[at])]:
                    if at + len(words) <= off[d + 1] and codes[at : at + len(words)].tolist() == words:
                        found[d][item] = 1.0
        w2 = p.idf2[codes]
        total = np.concatenate([[0], np.cumsum(w2)])
        inner = np.concatenate([[0], np.cumsum(np.where(codes >= 0, w2, 0))])
        for tier in np.unique(p.tier[p.tier > 0]):
            step, items = int(tier) // 8, np.flatnonzero(p.tier == tier)
            latent, norm = p.latent[items], self.norm[items]
            n = np.where(lens > 0, np.maximum(0, -(-(lens - tier) // step)) + 1, 0)
            doc = np.repeat(np.arange(len(texts)), n)
            start = off[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * step
            end = np.minimum(start + tier, off[doc + 1])
            mass = total[end] - total[start]
            held = np.concatenate([[0], np.cumsum(self.most[int(tier)][codes])])
            # the share is at most the first bound, the cosine the root of the second
            by_share = held[end] - held[start] >= self.cosine * (1 - 1e-6)
            light = (mass < norm.max() ** 2) & (inner[end] - inner[start] >= self.cosine**2 * mass * (1 - 1e-9))
            left = np.flatnonzero(by_share | light)
            for at in range(0, len(left), 4096):
                part = left[at : at + 4096]
                z = np.empty((len(part), p.vectors.shape[1]), np.float32)
                for k, (i, j) in enumerate(zip(start[part].tolist(), end[part].tolist())):
                    u, v = weights(codes[i:j], p.idf2)
                    z[k] = v @ p.vectors[u]
                for k, m in np.argwhere(z @ latent.T >= self.cosine * np.minimum(np.sqrt(mass[part])[:, None], norm) * (1 - 1e-6)).tolist():
                    i, item = part[k], int(items[m])
                    d = int(doc[i])
                    a, b = max(0, int(start[i] - off[d]) - int(tier) // 2), int(end[i] - off[d]) + int(tier) // 2
                    if found[d].get(item, 0) < 1 and (got := self.verify(item, texts[d][a:b])) > found[d].get(item, 0):
                        found[d][item] = got
        return found


def finder(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, lcs_share: float = LCS_SHARE):
    """A function from texts (UTF-8) to the item_ids found in each and the best share, fitted
    on all rows of ``docs`` and ``benchmark``; for use inside tasks."""
    models = [docs.sparkSession.sparkContext.broadcast(fit(docs, p)) for p in load_blocks(benchmark)]
    made: list[Matcher] = []

    def find(raw: list[bytes]) -> tuple[list[list[int]], np.ndarray]:
        if not made:
            made.extend(Matcher(m.value, cosine, lcs_share) for m in models)
        texts = [tokens(t) for t in raw]
        items: list[set[int]] = [set() for _ in texts]
        best = np.zeros(len(texts))
        for m in made:
            for i, hits in enumerate(m.find(texts)):
                items[i].update(m.p.ids[item] for item in hits)
                best[i] = max([best[i], *hits.values()])
        return [sorted(x) for x in items], best

    return find


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, lcs_share: float = LCS_SHARE) -> DataFrame:
    """doc_id, contaminated, kept, n_items, items (item_ids, ascending), best_share: a row for
    each row of ``docs``.

    A null text holds nothing.  Passages without text, without item_id, or with under five
    words and twelve letters are left out.  Repeated passages are each found.  An empty benchmark flags nothing."""
    find = finder(docs, benchmark, cosine, lcs_share)

    def block(part: pa.RecordBatch) -> dict:
        items, best = find(as_bytes(part.column(1)))
        n = np.fromiter(map(len, items), np.int64, len(items))
        return {"doc_id": part.column(0), "contaminated": n > 0, "kept": n == 0, "n_items": n, "items": pa.array(items, pa.list_(pa.int64())), "best_share": best}

    return map_text(docs, [F.col("doc_id").cast("long"), F.col("text").cast("string")], "doc_id long, contaminated boolean, kept boolean, n_items long, items array<long>, best_share double", block, SLICE_BYTES // 2)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` in which no benchmark passage is found, all columns."""
    find = finder(docs, benchmark)
    return filter_texts(docs, lambda texts: [not x for x in find([t.encode() for t in texts])[0]])


def op10_latent_retrieval(spark, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

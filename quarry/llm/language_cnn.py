"""Language identification by a byte convolutional network.

Bytes of the lower-cased text are embedded, filters of several widths run over a window of
fixed length, each keeps its maximum, and a softmax gives the language.  Training is numpy
on a bounded sample of labelled rows.  A text is cut into windows over its whole length
(overlapping so that no n-gram is lost); its probabilities are the windows', weighted by
their bytes.  Rows are independent, so prediction is one pass without a shuffle; the model
is a few kilobytes whatever the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod5, filter_texts, map_text, table

WINDOW = 256
WIDTHS = (2, 3, 4)
STRIDE = WINDOW - max(WIDTHS) + 1
#: The bounded training sample: about so many rows a language, so many windows a row at most.
SAMPLE_ROWS, SAMPLE_WINDOWS = 500, 4
#: More distinct labels than this aren't languages.
MAX_LANGS = 10_000


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts (zero-padded), the text of each, and the text bytes in each."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    n = np.maximum(1, -(-(lens - (WINDOW - STRIDE)) // STRIDE))
    size = n * STRIDE + WINDOW - STRIDE
    flat = np.frombuffer(b"".join(b.ljust(s, b"\0") for b, s in zip(raw, size.tolist())), np.uint8)
    of = np.repeat(np.arange(len(raw)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(np.cumsum(size) - size, n) + k * STRIDE
    return flat[start[:, None] + np.arange(WINDOW)], of, np.clip(lens[of] - k * STRIDE, 1, STRIDE)


@dataclass
class ByteCnn:
    langs: list[str]
    emb: np.ndarray  # (256, E); byte 0 is padding
    kernel: np.ndarray  # (max width, E, all filters); zero beyond a filter's width
    width: np.ndarray  # of each filter
    bias: np.ndarray
    out: np.ndarray  # (filters, langs)
    out_bias: np.ndarray

    def pooled(self, x: np.ndarray, where: bool = False):
        """Largest response of each filter in each window, and on request where."""
        n, length = x.shape
        e = self.emb[x].reshape(n * length, -1)
        resp = e @ self.kernel[0]
        for j in range(1, len(self.kernel)):
            on = np.searchsorted(self.width, j, "right")  # filters are in order of width
            resp[:-j, on:] += e[j:] @ self.kernel[j][:, on:]
        resp = resp.reshape(n, length, -1)
        top = np.empty((n, resp.shape[2]), np.float32)
        at = np.empty(top.shape, np.int64) if where else None
        for w in np.unique(self.width):  # a filter's places end where it would leave the window
            part = resp[:, : length - w + 1, self.width == w]
            if where:
                at[:, self.width == w] = part.argmax(1)
            top[:, self.width == w] = part.max(1)
        return top + self.bias, at

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.concatenate([np.maximum(self.pooled(x[i : i + 128])[0], 0) for i in range(0, len(x), 128)]) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train_cnn(x: np.ndarray, y: np.ndarray, langs: list[str], filters: int = 16, dim: int = 8, epochs: int = 6, seed: int = 7) -> ByteCnn:
    """Adam on cross-entropy; every language has the same weight."""
    rng = np.random.default_rng(seed)
    width = np.repeat(WIDTHS, filters)
    m = ByteCnn(langs, rng.normal(0, 0.5, (256, dim)).astype(np.float32), rng.normal(0, 0.3, (max(WIDTHS), dim, len(width))).astype(np.float32), width, np.zeros(len(width), np.float32), rng.normal(0, 0.1, (len(width), len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    m.emb[0] = 0
    for j in range(max(WIDTHS)):
        m.kernel[j][:, width <= j] = 0
    params = [m.emb, m.kernel, m.bias, m.out, m.out_bias]
    mom = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    weight = (len(y) / np.maximum(1, np.bincount(y, minlength=len(langs))) / len(langs)).astype(np.float32)[y]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 64):
            b = order[i : i + 64]
            xb, yb = x[b], y[b]
            pre, at = m.pooled(xb, True)
            act = np.maximum(pre, 0)
            z = act @ m.out + m.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(b)), yb] -= 1
            p *= weight[b][:, None] / len(b)
            g = (p @ m.out.T) * (pre > 0)
            gk, ge = np.zeros_like(m.kernel), np.zeros_like(m.emb)
            f = np.arange(len(width))
            for j in range(max(WIDTHS)):
                on = f[width > j]
                byte = xb[np.arange(len(b))[:, None], at[:, on] + j]
                gk[j][:, on] = np.einsum("nf,nfe->ef", g[:, on], m.emb[byte])
                np.add.at(ge, byte, g[:, on, None] * m.kernel[j][:, on].T)
            ge[0] = 0
            step += 1
            for q, grad, (a, v) in zip(params, [ge, gk, g.sum(0), act.T @ p, p.sum(0)], mom):
                a += 0.1 * (grad - a)
                v += 0.01 * (grad * grad - v)
                q -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return m


def training_windows(docs: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of a bounded sample: about ``rows`` rows of each language by a hash of doc_id,
    up to SAMPLE_WINDOWS windows spread over each.  Rows whose crc32(doc_id) mod 5 is 0, or
    without lang or a letter, are not learned from."""
    fit = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string").alias("lang")).filter((crc_mod5() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = fit.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} distinct lang values")
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, rows / r["count"])) for r in counts], "lang string, rate double")
    drawn = fit.join(F.broadcast(rates), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 32)) < F.col("rate") * F.lit(float(1 << 32)))

    def cut(batches):
        for batch in batches:
            out: dict = {"doc_id": [], "lang": [], "w": []}
            for i, lang, t in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if any(map(str.isalpha, t)):
                    w = windows([t])[0]
                    for k in np.unique(np.linspace(0, len(w) - 1, min(len(w), SAMPLE_WINDOWS)).astype(int)):
                        out["doc_id"].append(i), out["lang"].append(lang), out["w"].append(w[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["lang"], pa.string()), pa.array(out["w"], pa.binary())], list(out))

    got = sorted((r["lang"], r["doc_id"], bytes(r["w"])) for r in drawn.select("doc_id", "lang", "text").mapInArrow(cut, "doc_id long, lang string, w binary").collect())
    langs = sorted({g[0] for g in got})
    x = np.frombuffer(b"".join(g[2] for g in got), np.uint8).reshape(-1, WINDOW)
    return x, np.array([langs.index(g[0]) for g in got], np.int64), langs


def fit_languages(docs: DataFrame, rows: int = SAMPLE_ROWS) -> ByteCnn | None:
    """None if there is nothing to learn from."""
    x, y, langs = training_windows(docs, rows)
    return train_cnn(x, y, langs) if len(x) else None


def identify(model: ByteCnn | None, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and windows of each text; ``und`` and 0 without a letter or a model."""
    has = np.fromiter((any(map(str.isalpha, t)) for t in texts), bool, len(texts))
    lang, score, count = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    if model is not None and has.any():
        rows = np.flatnonzero(has)
        x, of, n = windows([texts[i] for i in rows])
        p = model.probabilities(x) * n[:, None]
        total = np.add.reduceat(p, np.searchsorted(of, np.arange(len(rows))), axis=0)
        total /= total.sum(1, keepdims=True)
        best = total.argmax(1)
        lang[rows] = np.array(model.langs, object)[best]
        score[rows] = np.clip(total[np.arange(len(rows)), best], 0, 1)
        count[rows] = np.bincount(of, minlength=len(rows))
    return lang, score, count


def predict_languages(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_windows: a row for each row of ``docs``.

    ``und`` with score 0 if the text is null or has no letter, or if there is no model.  Only
    doc_id and text are read; doc_id decides held_out alone (null id: held out)."""

    def block(part: pa.RecordBatch) -> dict:
        lang, score, count = identify(model, part.column(1).fill_null("").to_pylist())
        return {"doc_id": part.column(0), "held_out": part.column(2), "lang_pred": pa.array(lang.tolist(), pa.string()), "score": score, "n_windows": count}

    return map_text(docs, [F.col("doc_id").cast("long"), "text", (crc_mod5() == 0).alias("held_out")], "doc_id long, held_out boolean, lang_pred string, score double, n_windows long", block)


#: A text whose best language has less than this is in none of the languages learned.
MIN_SCORE = 0.3


def keep_languages(docs: DataFrame, model: ByteCnn | None, min_score: float = MIN_SCORE) -> DataFrame:
    """Rows of ``docs`` with a language: not ``und``, and ``min_score`` at least.  Without a
    model (no labelled row) nothing can be told apart, so every row stays."""
    if model is None:
        return docs

    def has_language(texts: list[str]) -> list[bool]:
        lang, score, _ = identify(model, texts)
        return ((lang != "und") & (score >= min_score)).tolist()

    return filter_texts(docs, has_language)


def op3_byte_cnn(spark, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, fit_languages(docs))

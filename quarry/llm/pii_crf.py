"""Personal data by patterns and a linear-chain conditional random field.

The patterns (email, ip, card, phone) give the base spans.  The field reads a text as its
sequence of words, each as a word shape, and adds spans that the patterns do not match at
all.  It is trained in numpy (exact gradient by forward-backward) on a small labelled table:
word windows around labelled spans.  ``labelled_windows`` makes that table from a bounded
sample of documents with the patterns as labels, and from rewritten forms of the same
spans.  Decoding is Viterbi over batches of whole texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import hash_share, map_rows, map_text, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
#: Rows drawn for the labelled table, and windows kept of them.
SAMPLE_ROWS, SAMPLE_WINDOWS, SIDE = 20_000, 3_000, 8

# --- patterns -----------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't start inside a run of digits: possessive runs keep long numbers linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_IN_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part is the run before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and text[start - 1] in _IN_LOCAL:
                start -= 1
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                yield start, m.end()
                end = m.end()
        at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Every leftmost match of each pattern, and whether it passes its test."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b, True
    if not _DIGIT.search(text):
        return
    if "." in text:
        for m in _IP.finditer(text):
            yield "ip", *m.span(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        yield "card", *m.span(), 14 <= len(d) <= 19 and _luhn(d)
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield "phone", *m.span(), 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- word shapes --------------------------------------------------------------------------

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_PIECES = re.compile("([A-Z]+)|([a-z]+)|([0-9]+)|(.)", re.S)
_LENGTH = re.compile("([0-9]+)#")


def shape(word: str) -> str:
    """Runs of letters as A, Aa or a; runs of digits as their length (to 5, then 6, 9, 14, 20
    for that and more); other characters as they are, at most twice in a row."""
    if word.isalpha():
        return "a" if word.islower() else "Aa"
    word = "".join(c if c.isascii() else "a" if c.isalpha() else "?" for c in word[:64]) + ("~" if len(word) > 64 else "")
    out: list[str] = []
    for upper, lower, digits, other in _PIECES.findall(word):
        n = len(digits)
        s = "A" if upper else "a" if lower else str(next(x for x in (20, 14, 9, 6, n) if n >= x)) + "#" if n else other
        if not (len(out) > 1 and out[-1] == out[-2] == s) and len(out) < 24:
            out.append(s)
    return "".join(out)


def shape_features(s: str) -> list[str]:
    core = s.strip(".,;:!?()[]<>\"'")
    return ["bias", f"shape={s}", f"core={core}", f"first={s[:1]}", f"last={s[-1:]}", f"at={'@' in s}", f"plus={'+' in s}", f"dots={min(3, core.count('.'))}", f"digits={min(4, s.count('#'))}", f"total={min(20, sum(map(int, _LENGTH.findall(s))))}", f"hyphens={min(5, core.count('-'))}", f"paren={'(' in s}{')' in s}", f"plain={core in ('a', 'Aa', 'A', '')}"]


ROLES = ("cur", "prev", "next")


@dataclass
class Crf:
    weights: dict[str, dict[str, np.ndarray]]  # role -> feature -> score of each label
    start: np.ndarray
    trans: np.ndarray

    def emissions(self, shapes: list[str]) -> np.ndarray:
        """(roles, shapes, labels); a feature not seen in training adds nothing."""
        zero = np.zeros(len(LABELS))
        return np.array([[sum((self.weights[r].get(f, zero) for f in shape_features(s)), zero) for s in shapes] for r in ROLES]).reshape(len(ROLES), len(shapes), len(LABELS))


def scores(em: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Scores (texts, words, labels) of padded shape ids; neighbours beyond the ends add nothing."""
    e = em[0][ids]
    inside = np.arange(ids.shape[1]) < lens[:, None]
    e[:, 1:] += em[1][ids[:, :-1]]
    e[:, :-1] += em[2][ids[:, 1:]] * inside[:, 1:, None]
    return e


def viterbi(model: Crf, e: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Best labels (texts, words), for texts in a padded batch."""
    n, steps, k = e.shape
    back = np.zeros((steps, n, k), np.int8)
    s = model.start + e[:, 0]
    last = s.copy()
    for t in range(1, steps):
        cand = s[:, :, None] + model.trans
        back[t] = cand.argmax(1)
        s = cand.max(1) + e[:, t]
        on = lens > t
        last[on] = s[on]
    out = np.zeros((n, steps), np.int8)
    rows, cur = np.arange(n), last.argmax(1)
    for t in range(steps - 1, -1, -1):
        on = lens > t
        out[on, t] = cur[on]
        if t:
            cur = np.where(on, back[t, rows, cur], cur)
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def train_crf(windows: list[tuple[list[str], list[int]]], epochs: int = 60, l2: float = 1e-3) -> Crf:
    """Maximum likelihood by Adam on all windows (shapes, labels) at a time."""
    k = len(LABELS)
    seqs = [w for w in windows if w[0]]
    shapes = sorted({s for x, _ in seqs for s in x})
    index = {s: i for i, s in enumerate(shapes)}
    feats = sorted({f for s in shapes for f in shape_features(s)})
    at = {f: i for i, f in enumerate(feats)}
    phi = np.zeros((len(shapes), len(feats)))
    for i, s in enumerate(shapes):
        phi[i, [at[f] for f in shape_features(s)]] = 1
    n, steps = len(seqs), max((len(x) for x, _ in seqs), default=1)
    ids, gold, lens = np.zeros((n, steps), np.int64), np.zeros((n, steps), np.int64), np.array([len(x) for x, _ in seqs], np.int64)
    for i, (x, y) in enumerate(seqs):
        ids[i, : len(x)], gold[i, : len(x)] = [index[s] for s in x], y
    inside = np.arange(steps) < lens[:, None]
    params = [np.zeros((3, len(feats), k)), np.zeros(k), np.zeros((k, k))]
    mom = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, epochs + 1 if n else 1):
        w, start, trans = params
        em = phi @ w
        e = scores(em, ids, lens)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = start + e[:, 0]
        for t in range(1, steps):
            alpha[:, t] = np.where(inside[:, t, None], _lse(alpha[:, t - 1, :, None] + trans, 1) + e[:, t], alpha[:, t - 1])
        for t in range(steps - 2, -1, -1):
            beta[:, t] = np.where(inside[:, t + 1, None], _lse(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        z = _lse(alpha[:, -1], 1)
        unary = np.exp(alpha + beta - z[:, None, None]) * inside[..., None]
        unary[inside] -= np.eye(k)[gold[inside]]
        gt = np.zeros((k, k))
        for t in range(1, steps):
            on = inside[:, t]
            pair = np.exp(alpha[on, t - 1, :, None] + trans + (e[on, t] + beta[on, t])[:, None, :] - z[on, None, None])
            gt += pair.sum(0)
            np.subtract.at(gt, (gold[on, t - 1], gold[on, t]), 1)
        ge = np.zeros_like(em)
        np.add.at(ge[0], ids, unary)
        np.add.at(ge[1], ids[:, :-1], unary[:, 1:])
        np.add.at(ge[2], ids[:, 1:], unary[:, :-1] * inside[:, 1:, None])
        grads = [phi.T @ ge / n + l2 * w, unary[:, 0].sum(0) / n, gt / n + l2 * trans]
        for q, g, (a, v) in zip(params, grads, mom):
            a += 0.1 * (g - a)
            v += 0.01 * (g * g - v)
            q -= 0.2 * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w, start, trans = params
    if not n:  # nothing to learn from: every word is O
        start = np.where(np.arange(k) == 0, 0.0, -1e6)
        trans = np.tile(start, (k, 1))
    return Crf({r: {f: w[i, at[f]] for f in feats} for i, r in enumerate(ROLES)}, start, trans)


# --- the labelled table ---------------------------------------------------------------------


def window(text: str, spans: list[tuple[str, int, int]], around: int) -> tuple[list[str], list[int]]:
    """Shapes and labels of the words within SIDE words of the word at ``around``."""
    words = list(_WORD.finditer(text, max(0, around - 400), around + 400))
    if not words:
        return [], []
    mid = min(range(len(words)), key=lambda i: abs(words[i].start() - around))
    words = words[max(0, mid - SIDE) : mid + SIDE + 1]
    label = lambda m: next((LABELS.index(k) for k, a, b in spans if a < m.end() and m.start() < b), 0)
    return [shape(m[0]) for m in words], [label(m) for m in words]


#: Other ways to write a span, for the labelled table.
REWRITES = {
    "phone": (lambda s: s[1:], lambda s: re.sub(r"^\+[0-9]+[ .-]?", "", s), lambda s: "00" + s[1:], lambda s: re.sub(r"[()]", "", s)[1:].replace(" ", "."), *(lambda s, lead=lead, mark=mark, skip=skip: lead + mark.join(re.findall("[0-9]+", s)[skip:]) for lead, mark, skip in (("", " ", 0), ("", "-", 0), ("00", " ", 0), ("00", "-", 0), ("0", " ", 1), ("", "-", 1))), *(lambda s, lead=lead, skip=skip: lead + "-".join(re.findall("..?", re.sub(r"\D", "", s)[skip:])) for lead, skip in (("0", 0), ("033-1-", 3)))),
    "email": (lambda s: s.replace("@", "(at)"), lambda s: s.replace("@", "[at]"), lambda s: s.replace("@", " @ ")),
    "card": (lambda s: ".".join(re.findall(".{1,4}", re.sub(r"\D", "", s))),),
    "ip": (),
}


def labelled_windows(docs: DataFrame, rows: int = SAMPLE_ROWS, limit: int = SAMPLE_WINDOWS) -> list[tuple[list[str], list[int]]]:
    """The small labelled table: windows around the pattern spans of about ``rows`` documents
    drawn by a hash of doc_id, around the same spans written in other ways (REWRITES), and
    around words with digits that are no span.  At most ``limit`` come to the driver."""
    total = docs.count()
    drawn = docs.select(F.col("doc_id").cast("long"), "text").filter(hash_share(min(1.0, rows / max(1, total)), seed=11) & F.col("text").isNotNull())

    def cut(batches):
        for batch in batches:
            out: dict = {"key": [], "shapes": [], "labels": []}
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(matches(text))
                good = in_order([m[:3] for m in found if m[3]])
                made = []
                for kind, a, b in good[:4]:
                    made.append(window(text, good, a))
                    for rewrite in REWRITES[kind]:
                        new = rewrite(text[a:b])
                        made.append(window(text[max(0, a - 300) : a] + new + text[b : b + 300], [(kind, min(300, a), min(300, a) + len(new))], min(300, a)))
                for m in list(_DIGIT.finditer(text))[:200:50]:
                    if not any(a - 1 <= m.start() <= b for _, a, b, _ in found):
                        made.append(window(text, good, m.start()))
                for n, (x, y) in enumerate(made):
                    out["key"].append(f"{i}:{n}"), out["shapes"].append(x), out["labels"].append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.string()), pa.array(out["shapes"], pa.list_(pa.string())), pa.array(out["labels"], pa.list_(pa.int64()))], list(out))

    rows_ = drawn.mapInArrow(cut, "key string, shapes array<string>, labels array<long>").orderBy(F.xxhash64("key"), "key").limit(limit).collect()
    return [(list(r["shapes"]), list(r["labels"])) for r in rows_]


# --- finding ----------------------------------------------------------------------------------

#: Padded words of a Viterbi batch.
BATCH_WORDS = 150_000


def decode(model: Crf, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans that the field finds: runs of words with one label, without the marks around them."""
    words = [[m.span() for m in _WORD.finditer(t)] for t in texts]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    seen: dict[str, int] = {}
    known: dict[str, int] = {}
    ids = []
    for t, ws in zip(texts, words):
        row = np.empty(len(ws), np.int64)
        for j, (a, b) in enumerate(ws):
            w = t[a:b]
            i = seen.get(w)
            if i is None:
                s = shape(w)
                i = seen[w] = known.setdefault(s, len(known))
            row[j] = i
        ids.append(row)
    em = model.emissions(list(known))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    order = [i for i in np.argsort(-lens, kind="stable") if lens[i]]
    at = 0
    while at < len(order):
        longest = int(lens[order[at]])
        # texts of like length together: at most twice the steps that the shortest needs
        to = at
        while to < len(order) and 2 * lens[order[to]] >= longest and (to == at or (to - at + 1) * longest <= BATCH_WORDS):
            to += 1
        rows = order[at:to]
        pad = np.zeros((len(rows), longest), np.int64)
        for r, i in enumerate(rows):
            pad[r, : lens[i]] = ids[i]
        labels = viterbi(model, scores(em, pad, lens[rows]), lens[rows])
        for r in np.flatnonzero(labels.any(1)):
            i, y = rows[r], labels[r, : lens[rows[r]]]
            cut = np.flatnonzero(np.diff(y)) + 1
            for a, b in zip([0, *cut], [*cut, len(y)]):
                if y[a]:
                    start, end = words[i][a][0], words[i][b - 1][1]
                    body = texts[i][start:end]
                    lead = len(body) - len(body.lstrip(".,;:!?\"'<>[]{}"))
                    body = body[lead:].rstrip(".,;:!?\"'<>[]{}(")
                    if body:
                        out[i].append((LABELS[y[a]], start + lead, start + lead + len(body)))
        at = to
    return out


_AT = re.compile(r"@|[\[({] ?at ?[\])}]", re.I)


def plausible(kind: str, body: str) -> bool:
    """What a span of the field must hold to be added."""
    digits = sum("0" <= c <= "9" for c in body)
    return {"email": bool(_AT.search(body)) and "." in body, "ip": digits >= 4, "card": 14 <= digits <= 19, "phone": 7 <= digits <= 15}[kind]


def added_spans(text: str, found: list[tuple[str, int, int, bool]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans of the field to add to those of the patterns, which found ``found``."""
    n_digits = lambda a, b: sum("0" <= c <= "9" for c in text[a:b])
    fixed = [m for m in found if m[0] != "card" or m[3]]
    # numbers that are no card; one of 14 digits or more failed as a card
    runs = [(a, b, n_digits(a, b)) for kind, a, b, ok in found if kind == "card" and not ok]
    out: list[tuple[str, int, int]] = []
    for kind, start, end in more:
        over = [(a, b, n) for a, b, n in runs if a < end and start < b]
        if kind == "card" and any(n >= 14 for _, _, n in over):
            continue
        if kind == "phone":
            if any(16 <= n <= 19 for _, _, n in over):  # too long for a phone
                continue
            # the field may have labelled some words of a number only
            for a, b, n in over:
                if n <= 15 and a <= start and end <= b:
                    start, end = a, b
        if plausible(kind, text[start:end]) and not any(a < end and start < b for _, a, b, _ in fixed) and (kind, start, end) not in out:
            out.append((kind, start, end))
    return out


def find_spans(model: Crf, texts: list[str]) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of each text.  A span of the field is added if no pattern
    matches any part of it: what a pattern matches and its test drops stays dropped.  A number
    that the card pattern matches is a failed card where it has 14 digits and the field calls
    it a card, or 16 to 19 digits; else it can be a phone, and then all of it is."""
    result = []
    for text, more in zip(texts, decode(model, texts)):
        found = list(matches(text))
        base = in_order([m[:3] for m in found if m[3]])
        result.append((base, in_order(base + added_spans(text, found, more))))
    return result


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added: a row
    for each row of ``docs``.  Offsets are code points, end exclusive.  Null text is empty;
    repeated rows give repeated results; other columns are not read."""

    def block(part: pa.RecordBatch) -> dict:
        found = find_spans(model, part.column(1).fill_null("").to_pylist())
        out: dict = {"doc_id": part.column(0)}
        for kind in KINDS:
            out[f"n_{kind}"] = np.fromiter((sum(s[0] == kind for s in base) for base, _ in found), np.int64, len(found))
        out["base_sha256"] = pa.array([hashlib.sha256(spans_text(b).encode()).hexdigest() for b, _ in found], pa.string())
        out["spans"] = pa.array([spans_text(a) for _, a in found], pa.string())
        out["n_added"] = np.fromiter((len(a) - len(b) for b, a in found), np.int64, len(found))
        return out

    return map_text(docs, [F.col("doc_id").cast("long"), "text"], "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", block)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each stretch that spans cover becomes the kind of its first span in brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, model: Crf, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with its personal data masked in ``text``, and ``n_chars`` (if there is such a
    column) counted anew for masked rows.  Every row and column stays; null text stays null."""

    count = docs.columns.index(n_chars) if n_chars in docs.columns else None

    def mask(part: pa.RecordBatch, at: int) -> pa.RecordBatch:
        old = part.column(at).to_pylist()
        new = [t if t is None else redact(t, spans) for t, (_, spans) in zip(old, find_spans(model, [t or "" for t in old]))]
        columns = list(part.columns)
        columns[at] = pa.array(new, part.schema.field(at).type)
        if count is not None:
            n = [len(b) if a != b else c for a, b, c in zip(old, new, part.column(count).to_pylist())]
            columns[count] = pa.array(n, part.schema.field(count).type)
        return pa.RecordBatch.from_arrays(columns, part.schema.names)

    return map_rows(docs, text, mask)


def op2_crf_spans(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents")
    return personal_data(docs, train_crf(labelled_windows(docs)))

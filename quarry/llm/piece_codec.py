"""SentencePiece (BPE) encoding by a prefix table, and decoding.

The library merges, again and again, the adjacent pair of symbols whose union is the best
piece, leftmost first.  What comes out of a text is its only split into pieces in which every
two neighbours are *compatible*: merged alone, the two stay as they are.  So the last piece of
every prefix is fixed by the prefixes before it: among the pieces that end there (all matches
of one Aho-Corasick automaton) it is the one that is compatible with the last piece of the
prefix where it starts.  One pass fills that table, one walk backwards reads the ids; nothing
is merged.

Two pieces are compatible if no merge takes the place of their border.  A piece is made by one
tree of merges; its *outer symbols* on the border side, each with the rank of the merge that
uses it up, are known from the vocabulary.  Walking both sides in order of rank, a union of
the two symbols at the border that is a piece of better rank than what uses either of them up
is such a merge.

A text is cut at its runs of spaces, which no piece crosses (``check_model``), and each
distinct pre-token of a task is encoded once.
"""

from __future__ import annotations

import hashlib
from array import array
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_text, table
from quarry.llm.token_counts import SPACE, check_model, default_model, pre_tokens

#: Remembered answers of a worker (speed and memory only): pairs of pieces, pre-tokens.
PAIRS, WORDS = 2_000_000, 300_000


class PieceCodec:
    """Prefix-table encoder and decoder of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        check_model(model)
        self.n = model.get_piece_size()
        self.piece = [model.id_to_piece(i) for i in range(self.n)]
        self.control = {i for i in range(self.n) if model.is_control(i)}
        self.unknown = model.unk_id()
        self.byte = {i: int(self.piece[i][3:5], 16) for i in range(self.n) if model.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte.items()}
        if len(self.byte_id) != 256 or any(model.is_unused(i) for i in range(self.n)):
            raise ValueError("a model with byte fallback and without unused pieces is needed")
        special = {*self.control, *self.byte, self.unknown}
        #: Rank of a union: the better the score, the smaller.
        self.rank = {p: -model.get_score(i) for i, p in enumerate(self.piece) if i not in special}
        self.id = {p: i for i, p in enumerate(self.piece) if i not in special}
        self.size = [len(p) for p in self.piece]
        self._derive()
        self.matches = ahocorasick.Automaton()
        for p in self.left:
            self.matches.add_word(p, self.id[p])
        self.matches.make_automaton()
        self.pairs: dict[int, bool] = {}

    def _derive(self) -> None:
        """Outer symbols of every piece that merging can make: ``right[p]`` is the symbols at
        its right end from the single character to p itself, each with the rank that uses it
        up; ``left[p]`` the same at its left end.  Other pieces never occur in an encoding."""
        self.left: dict[str, list[tuple[str, float]]] = {}
        self.right: dict[str, list[tuple[str, float]]] = {}
        for p in sorted(self.rank, key=lambda p: (len(p) > 1, self.rank[p], len(p))):
            if len(p) == 1:
                self.left[p] = self.right[p] = [(p, inf)]
                continue
            for at in range(1, len(p)):
                a, b = p[:at], p[at:]
                if a in self.left and b in self.left and self._border(a, b) == p:
                    r = self.rank[p]
                    self.left[p] = [*self.left[a][:-1], (a, r), (p, inf)]
                    self.right[p] = [*self.right[b][:-1], (b, r), (p, inf)]
                    break

    def _border(self, a: str, b: str) -> str | None:
        """The first union across the border of two neighbours, or None."""
        xs, ys = iter(self.right[a]), iter(self.left[b])
        (x, x_ends), (y, y_ends) = next(xs), next(ys)
        while True:
            r = self.rank.get(x + y, inf)
            if r < x_ends and r <= y_ends and r < inf:
                return x + y
            if x_ends == y_ends == inf:
                return None
            if x_ends <= y_ends:  # equal ranks: the left one goes first
                x, x_ends = next(xs)
            else:
                y, y_ends = next(ys)

    def compatible(self, a: int, b: int) -> bool:
        key = a * self.n + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._border(self.piece[a], self.piece[b]) is None
        return known

    def encode_piece_text(self, text: str) -> list[int]:
        """Ids of a text whose spaces are U+2581 and that has its prefix."""
        n, size, pairs, base = len(text), self.size, self.pairs, self.n
        last = [-1] * (n + 1) if n < 4096 else array("i", [-1]) * (n + 1)
        for end, t in self.matches.iter(text):
            if last[end + 1] < 0:
                start = end + 1 - size[t]
                before = last[start]  # -1: the start, or a character that no piece holds
                if before < 0:
                    last[end + 1] = t
                else:
                    fits = pairs.get(before * base + t)
                    if fits or fits is None and self.compatible(before, t):
                        last[end + 1] = t
        ids, at = [], n
        while at:
            t = last[at]
            if t >= 0:
                ids.append(t)
                at -= size[t]
            else:
                at -= 1
                ids += [self.byte_id[b] for b in reversed(text[at].encode())]
        ids.reverse()
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, as the library gives them without begin and end."""
        return [i for x in pre_tokens(text) for i in self.encode_piece_text(SPACE + x.replace(" ", SPACE))]

    def decode_inner(self, ids: list[int]) -> str:
        """Text of ids, the space that the encoder puts first still there."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.byte:
                run.append(self.byte[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i not in self.control:
                out.append(" ⁇ " if i == self.unknown else self.piece[i].replace(SPACE, " "))
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids, as the library gives it: control ids are nothing, one space before the first piece goes."""
        first = next((i for i in ids if i not in self.control), None)
        text = self.decode_inner(ids)
        return text[1:] if first is not None and self.piece[first].startswith(SPACE) else text


def _utf8(run: bytes) -> str:
    """Bytes of fallback ids as text; a byte outside any character is U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError as e:
        return run[: e.start].decode() + "�" + _utf8(run[e.start + 1 :])


class WordCodec:
    """Ids (joined), their number and decoded text of distinct pre-tokens."""

    def __init__(self, path: str):
        self.codec = PieceCodec(path)
        self.known: dict[str, tuple[str, int, str]] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > WORDS:
            self.known.clear()
        for x in words.difference(self.known):
            ids = self.codec.encode_piece_text(SPACE + x.replace(" ", SPACE))
            self.known[x] = (",".join(map(str, ids)), len(ids), self.codec.decode_inner(ids))

    def document(self, words: list[str]) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of the decoded text."""
        ids, n, text = zip(*[self.known[x] for x in words]) if words else ((), (), ())
        return sum(n), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256("".join(text)[1:].encode()).hexdigest()


_CODECS: dict[str, WordCodec] = {}  # one per worker and model


def word_codec(path: str) -> WordCodec:
    if path not in _CODECS:
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids: the ids of every whole text, a row for each row of ``docs``.  Null text is
    empty and has no id; repeated rows give repeated results; other columns are not read; an
    empty table gives an empty one."""
    path = model or default_model()

    def block(part: pa.RecordBatch) -> dict:
        codec = word_codec(path).codec
        ids = [codec.encode(t) for t in part.column(1).fill_null("").to_pylist()]
        return {"doc_id": part.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))}

    return map_text(docs, [F.col("doc_id").cast("long"), "text"], "doc_id long, ids array<int>", block)


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text from ``encode_documents``: null ids are no ids, an empty text."""
    path = model or default_model()

    def run(batches):
        codec = word_codec(path).codec
        for b in batches:
            text = [codec.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def codec_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: a row for each row of ``docs``, the ids and
    decoded texts themselves only inside the task.  Edge cases as in ``encode_documents``."""
    path = model or default_model()

    def block(part: pa.RecordBatch) -> dict:
        words = word_codec(path)
        lists = [pre_tokens(t) for t in part.column(1).fill_null("").to_pylist()]
        words.learn(set().union(*lists))
        n, ids, text = zip(*map(words.document, lists))
        return {"doc_id": part.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids), "decoded_sha256": pa.array(text)}

    return map_text(docs, [F.col("doc_id").cast("long"), "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", block)


def op12_prefix_table_codec(spark, sf_dir: str) -> DataFrame:
    """Every document encoded by the prefix table of piece_bpe_32k.model and decoded again."""
    return codec_digests(table(spark, sf_dir, "documents"))

"""Token counts from distinct pre-tokens.

The piece model (BPE, identity normaliser) writes a space as U+2581, puts one before the
text, and has no piece with U+2581 after another character.  So no piece crosses the start
of a run of spaces, and a text's count is the sum over its pre-tokens, each a run of spaces
with the characters up to the next run.  Distinct pre-tokens of a block of documents are
counted once, joined to the documents' pre-tokens by code, and summed; ids of a document
never exist.  ``check_model`` verifies the condition on the vocabulary.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_text, table

SPACE = "▁"
_RUN = re.compile(" +[^ ]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def check_model(model) -> None:
    for i in range(model.get_piece_size()):
        if SPACE in model.id_to_piece(i).lstrip(SPACE):
            raise ValueError(f"piece {i} crosses a word start: pre-tokens can't be counted apart")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without their first space (the model puts one before what it encodes)."""
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if not text:
        return []
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [x[1:] for x in _RUN.findall(" " + text)]


class PieceCounter:
    """Counts of pre-tokens, kept between blocks up to a number of entries (speed only)."""

    KEEP = 300_000

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        check_model(self.model)
        self.known: dict[str, int] = {}
        #: A lone space at the end: encode("") gives nothing.
        self.lone = len(self.model.encode("a ")) - len(self.model.encode("a"))

    def counts(self, distinct: list[str]) -> np.ndarray:
        new = [x for x in distinct if x not in self.known]
        if len(self.known) + len(new) > self.KEEP:
            self.known, new = {}, distinct
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.known.update(zip(part, map(len, self.model.encode(part, num_threads=1))))
        self.known[""] = self.lone
        return np.fromiter((self.known[x] for x in distinct), np.int64, len(distinct))


def token_counts(docs: DataFrame, model: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_pre_tokens: a row for each row of ``docs``.
    Null text is empty and has no token; repeated rows give repeated results; other columns
    are not read."""
    path = model or default_model()
    made: list[PieceCounter] = []  # one per task

    def block(part: pa.RecordBatch) -> dict:
        if not made:
            made.append(PieceCounter(path))
        counter = made[0]
        texts = part.column(1).fill_null("").to_pylist()
        lists = [pre_tokens(t) for t in texts]
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.empty(int(lens.sum()), object)
        at = 0
        for x in lists:
            flat[at : at + len(x)] = x
            at += len(x)
        codes, distinct = pd.factorize(flat)
        sums = np.concatenate([[0], np.cumsum(counter.counts(list(distinct))[codes])]) if len(flat) else np.zeros(1, np.int64)
        ends = np.cumsum(lens)
        n = sums[ends] - sums[ends - lens]
        return {"doc_id": part.column(0), "n_bytes": pc.binary_length(part.column(1)).fill_null(0).cast(pa.int64()), "n_tokens": n, "over_limit": n > limit, "n_pre_tokens": lens}

    return map_text(docs, [F.col("doc_id").cast("long"), "text"], "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_pre_tokens long", block)


def op8_pretoken_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document under piece_bpe_32k.model, flagged beyond 4,096."""
    return token_counts(table(spark, sf_dir, "documents"))

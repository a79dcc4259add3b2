"""Helpers shared by the training-data operators.

Words are maximal runs of characters other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``).  On UTF-8 bytes that is ``bytes.split()``, and
``bytes.lower()`` lower-cases A-Z and nothing else, so text stays undecoded.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import shared_path

#: Bytes of text held as Python objects at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later plans start from files
    that every executor sees, and the planner knows their size."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod5(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5 (null id: 0)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)), F.lit(0)).cast("int")


def as_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [b if b is not None else b"" for b in col.cast(kind).to_pylist()]


def text_slices(batches: Iterable[pa.RecordBatch], text: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about ``limit`` bytes of column ``text``
    (one row at least), whatever the batch size of the session."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64) + 64)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def hash_share(rate: float, id_col: str = "doc_id", seed: int = 1) -> Column:
    """True for about ``rate`` of the ids, the same ones on every run."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 32)) < F.lit(int(rate * (1 << 32)))


def map_text(df: DataFrame, columns: list, schema: str, fn: Callable[[pa.RecordBatch], dict], limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over the named columns (the text second), a bounded slice at a time.
    ``fn`` returns the output columns by name."""
    names = [f.split()[0] for f in _split_schema(schema)]

    def run(batches):
        for part in text_slices(batches, 1, limit):
            out = fn(part)
            yield pa.RecordBatch.from_arrays([_array(out[c]) for c in names], names)

    return df.select(*columns).mapInArrow(run, schema)


def map_rows(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch, int], pa.RecordBatch], limit: int = SLICE_BYTES // 2) -> DataFrame:
    """Rows of ``df`` with its columns, a bounded slice of texts at a time; ``fn`` gets the
    slice and the place of column ``text``."""
    at = df.columns.index(text)

    def run(batches):
        for part in text_slices(batches, at, limit):
            yield fn(part, at)

    return df.mapInArrow(run, df.schema)


def filter_texts(df: DataFrame, keep: Callable[[list[str]], list[bool]], text: str = "text") -> DataFrame:
    """Rows of ``df`` whose text (null: empty) is to be kept."""

    def fn(part: pa.RecordBatch, at: int) -> pa.RecordBatch:
        return part.filter(pa.array(keep(part.column(at).fill_null("").to_pylist()), pa.bool_()))

    return map_rows(df, text, fn)


def _split_schema(schema: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in schema:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]


def _array(x) -> pa.Array:
    return x if isinstance(x, pa.Array) else pa.array(x)


def hot_join(left: DataFrame, right: DataFrame, key: str, spread: list[Column], value: str, weight: str, top: int = 1000) -> DataFrame:
    """Left join to a table with one row per ``key``, without sending a hot key to one task.

    The ``top`` keys of greatest ``weight`` (rows on the left) are a table of at most
    ``top`` rows, so they are broadcast; other keys hold under 1/top of the rows each
    and join by shuffle.  Rows that a hot key has answered are spread by ``spread``.
    Null keys match nothing.  Adds ``value``."""
    hot = right.orderBy(F.desc(weight), key).limit(top).select(F.col(key).alias("__hk"), F.col(value).alias("__hv"))
    j = left.join(F.broadcast(hot), F.col(key) == F.col("__hk"), "left")
    done = F.col("__hk").isNotNull() | F.col(key).isNull()
    j = j.withColumn("__k", F.when(~done, F.col(key))).withColumn("__s", F.when(done, F.xxhash64(*spread)).otherwise(F.lit(0)))
    cold = right.select(F.col(key).alias("__k"), F.lit(0).cast("long").alias("__s"), F.col(value).alias("__cv"))
    return j.join(cold, ["__k", "__s"], "left").withColumn(value, F.coalesce("__hv", "__cv")).drop("__k", "__s", "__hk", "__hv", "__cv")


# --- files in the shared folder -------------------------------------------------------------


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def create_file(uri: str):
    fs, path = open_fs(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    with fs.open_output_stream(path) as out:
        yield out


def read_file(uri: str) -> np.ndarray:
    """Bytes of a shared file: memory-mapped where the folder is mounted, else read."""
    fs, path = open_fs(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=np.uint8, mode="r").view(np.ndarray)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=np.uint8)


# --- word ids and shingles -------------------------------------------------------------------

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def word_lists(texts: list[bytes], lower: bool = True) -> tuple[list[bytes], np.ndarray]:
    """Words of all texts in a row, and the offset of each text's first word (one more at the end)."""
    lists = [(t.lower() if lower else t).split() for t in texts]
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    words: list[bytes] = []
    for x in lists:
        words += x
    return words, offsets


def word_codes(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Code of each word, and the distinct words by code."""
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return codes, list(seen)


def hash_words(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def shingle_hashes(codes: np.ndarray, hashes: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each k-word shingle, text by text, and the offsets.  A text with
    fewer words has its whole sequence as one shingle; one without words has none."""
    h = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    lens = np.diff(offsets)
    roll = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        roll = mix(roll * _M1 + h[j : j + len(roll)] + np.uint64(j + 1))
    counts = np.where(lens >= k, lens - k + 1, (lens > 0).astype(np.int64))
    out_off = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(counts, out=out_off[1:])
    out = np.empty(out_off[-1], np.uint64)
    full = lens >= k
    if full.any():
        start, cnt = offsets[:-1][full], counts[full]
        inner = np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt)
        out[np.repeat(out_off[:-1][full], cnt) + inner] = roll[np.repeat(start, cnt) + inner]
    for i in np.flatnonzero((lens > 0) & ~full):
        x = np.uint64(len(lens[i : i + 1]) + int(lens[i]) * 7919)
        for v in h[offsets[i] : offsets[i + 1]]:
            x = mix(np.array([x], np.uint64) * _M1 + v + np.uint64(77))[0]
        out[out_off[i]] = x
    return out, out_off


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

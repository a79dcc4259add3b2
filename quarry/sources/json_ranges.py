"""JSON values of files that are cut anywhere.

Spark cuts a file into byte ranges and reads each as records that end in ``}``, which an object
ends in too.  What a range does to a reader that passes over it depends on the state in which
it is entered, inside a string or not and how many brackets deep, and that is a small function:
for each of the two string states the depth d becomes ``max(d + a, b)`` (a closing bracket too
many is ignored, hence the maximum) and the range is left in one string state.  A first scan
finds these functions, one row a range; composed in file order they give the state, the byte
offset and the unfinished value that each range starts with.  A second scan then reads every
range alone.  A value that crosses ranges is put together from its fragments, keyed by the range
it starts in.

A newline ends any string: JSON has none inside one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_path

_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
#: Bytes of text that a task looks at in one go, whatever Spark hands it at a time (64 MB).
PIECE = 4 << 20
_QUOTE, _BACKSLASH, _NEWLINE, _BRACE = ord('"'), ord("\\"), ord("\n"), ord("{")

_RANGE = "file string, start long"
#: Per range: bytes of the file, bytes read, first bracket, and for both string states at entry the step, floor and lowest
#: point of the depth and the string state at the end.
_EFFECT = _RANGE + ", bytes long, size long, opens string, a0 long, b0 long, low0 long, out0 boolean, a1 long, b1 long, low1 long, out1 boolean"
#: Per range: string state and depth at entry, byte offset, depth of the values, the range where the value
#: that is open at entry starts, and the end of the text if its last brace isn't the file's (else -1).
_ENTRY = _RANGE + ", inside boolean, depth long, offset long, level int, origin long, cut long"


class Brackets:
    """Brackets outside strings of a piece of JSON text, for a reader that enters it outside a
    string; ``first`` marks those of its first line, which are the other way round for one that
    enters inside."""

    def __init__(self, data: bytes):
        a = np.frombuffer(data, np.uint8)
        quotes = np.flatnonzero(a == _QUOTE)
        slashes = np.flatnonzero(a == _BACKSLASH)
        if len(slashes) and len(quotes):
            runs = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
            nth = np.arange(len(slashes)) - np.repeat(runs, np.diff(np.append(runs, len(slashes))))
            before = np.searchsorted(slashes, quotes - 1)
            hit = np.minimum(before, len(slashes) - 1)
            quotes = quotes[~((slashes[hit] == quotes - 1) & (nth[hit] % 2 == 0))]
        lines = np.flatnonzero(a == _NEWLINE)
        step = _STEP[a]
        self.pos = np.flatnonzero(step)
        self.step = step[self.pos].astype(np.int64)
        line = np.searchsorted(lines, self.pos)
        base = np.concatenate([[0], np.searchsorted(quotes, lines)])
        self.hidden = (np.searchsorted(quotes, self.pos) - base[line]) % 2 == 1
        self.first = line == 0
        self.many_lines = len(lines) > 0
        self.ends_inside = (len(quotes) - base[-1]) % 2 == 1

    def visible(self, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
        """Places and steps of the brackets outside strings, and the string state at the end."""
        hidden = self.hidden ^ (self.first & inside)
        return self.pos[~hidden], self.step[~hidden], self.ends_inside ^ (inside and not self.many_lines)


def _depths(step: np.ndarray, depth: int) -> np.ndarray:
    """Depth after each bracket, never under 0."""
    total = np.cumsum(step)
    return total + np.maximum(depth, -np.minimum.accumulate(total)) if len(step) else total


def _piece_numbers(column: pa.Array) -> np.ndarray:
    """For each row the number of the piece of about ``PIECE`` bytes that it starts in."""
    lengths = pc.binary_length(column).to_numpy().astype(np.int64)
    return (np.cumsum(lengths) - lengths) // PIECE


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``PIECE`` bytes of that column."""
    for batch in batches:
        cuts = np.flatnonzero(np.diff(_piece_numbers(batch.column(column)), prepend=-1)).tolist()
        for at, to in zip(cuts, [*cuts[1:], batch.num_rows]):
            yield batch.slice(at, to - at)


def _pieces(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, bytes]]:
    """The first ``columns`` columns of each run of rows of one range, and the text of the run,
    which is cut after about ``PIECE`` bytes."""
    for batch in batches:
        starts, n = batch.column(1).to_numpy(), batch.num_rows
        files = batch.column(0).dictionary_encode().indices.to_numpy()
        pieces = _piece_numbers(batch.column(columns))
        cuts = np.flatnonzero((np.diff(starts, prepend=-1) != 0) | (np.diff(files, prepend=-1) != 0) | (np.diff(pieces, prepend=-1) != 0)).tolist()
        for at, to in zip(cuts, [*cuts[1:], n]):
            part = batch.slice(at, to - at)
            yield tuple(part.column(i)[0].as_py() for i in range(columns)), b"}".join(part.column(columns).to_pylist()) + b"}"


def _effects(batches):
    """``_EFFECT`` rows of the ranges of a task; their rows come together and in order."""
    state, key = None, None

    def emit():
        sums, row = state["by"], [*key, state["size"], state["opens"]]
        for entry in (False, True):
            row += [sums[entry][0], sums[entry][0] - sums[entry][1], sums[entry][1], sums[entry][2]]
        return _row(_EFFECT, row)

    for this, data in _pieces(batches, 3):
        if this != key:
            if key is not None:
                yield emit()
            key, state = this, {"size": 0, "opens": "", "by": {False: [0, 0, False], True: [0, 0, True]}}
        brackets = Brackets(data)
        state["size"] += len(data)
        for entry, by in state["by"].items():
            pos, step, out = brackets.visible(by[2])
            if len(step):
                total = np.cumsum(step)
                by[1] = min(by[1], by[0] + int(total.min()))
                by[0] += int(total[-1])
                if not entry and not state["opens"]:
                    state["opens"] = chr(data[pos[0]])
            by[2] = bool(out)
    if key is not None:
        yield emit()


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, ddl.split(", "))])


def _compose(array: bool):
    """Entry states of the ranges of one file, in order."""

    def fold(ranges):
        rows, level = [], None
        size = int(ranges["size"].sum())
        cut = size if size == ranges["bytes"].iloc[0] + 1 else -1  # (a compressed file ends as it ends)
        inside, depth, offset, origin, returned = False, 0, 0, -1, True
        before = -1
        for r in ranges.sort_values("start").itertuples(index=False):
            if level is None:
                level = 1 if array and r.opens == "[" else 0
            origin = -1 if depth <= level else before if returned else origin
            rows.append((r.file, r.start, inside, depth, offset, level, origin, cut))
            a, b, low, out = (r.a1, r.b1, r.low1, r.out1) if inside else (r.a0, r.b0, r.low0, r.out0)
            returned = depth + low <= level
            inside, depth, offset, before = out, max(depth + a, b), offset + r.size, r.start
        return _frame(rows)

    return fold


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_arrow(_ENTRY).names)


def _values(fragments: bool):
    """Whole values of ranges (file, offset, value), or what is left of those that cross their
    bounds (file, origin, start, offset, value)."""

    def run(batches):
        key = None
        for this, data in _pieces(batches, 8):
            file, start, inside0, depth0, offset0, level, origin, cut = this
            if (file, start) != key:
                if fragments and key is not None and tail is not None:
                    yield _row(_FRAGMENT, (key[0], key[1], key[1], began, b"".join(tail)))
                key, inside, depth, offset = (file, start), inside0, depth0, offset0
                tail, began = None, 0  # the value that starts in this range and is open
                head = [] if depth > level else None  # what is left of one that is open at entry
            if offset + len(data) == cut:
                data = data[:-1]
            pos, step, inside = Brackets(data).visible(inside)
            after = _depths(step, depth)
            opened = np.concatenate([[depth], after[:-1]]) if len(after) else after
            ends = pos[(step < 0) & (after <= level) & (opened > level)]
            codes = np.frombuffer(data, np.uint8)[pos]
            starts = pos[(codes == _BRACE) & (opened == level)]
            at = 0
            if head is not None:
                at = int(ends[0]) + 1 if len(ends) else len(data)
                head.append(data[:at])
                if len(ends):
                    if fragments:
                        yield _row(_FRAGMENT, (file, origin, start, offset, b"".join(head)))
                    head = None
                elif fragments:  # a range in the middle of a value, batch by batch
                    yield _row(_FRAGMENT, (file, origin, start, offset, b"".join(head)))
                    head = []
            found = []
            if tail is not None:
                at = int(ends[0]) + 1 if len(ends) else len(data)
                tail.append(data[:at])
                if len(ends):
                    found.append((began, b"".join(tail)))
                    tail = None
            first = np.searchsorted(starts, at)
            to = np.searchsorted(ends, starts[first:])
            for s, e in zip(starts[first:].tolist(), to.tolist()):
                if e < len(ends):
                    found.append((offset + s, data[s : int(ends[e]) + 1]))
                else:
                    tail, began = [data[s:]], offset + s
            if not fragments and found:
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(found)), pa.array([o for o, _ in found], pa.int64()), pa.array([v for _, v in found], pa.binary())], ["file", "offset", "value"])
            offset += len(data)
            depth = int(after[-1]) if len(after) else depth
        if fragments and key is not None and tail is not None:
            yield _row(_FRAGMENT, (key[0], key[1], key[1], began, b"".join(tail)))

    return run


_OBJECT = "file string, offset long, value string"
_FRAGMENT = "file string, origin long, start long, offset long, value binary"


def _row(ddl: str, row) -> pa.RecordBatch:
    schema = _arrow(ddl)
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)


def json_values(text: str) -> Iterator:
    """JSON values written one after another; after a broken one the rest of its line is passed over."""
    decode, at = json.JSONDecoder().raw_decode, 0
    while True:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        if at >= len(text):
            return
        try:
            value, at = decode(text, at)
        except (json.JSONDecodeError, RecursionError):
            end = text.find("\n", at)
            at = len(text) if end < 0 else end + 1
            continue
        yield value


def _objects(batches):
    """Text of the objects: a value that parses as it is, else those inside its later lines."""
    for batch in slices(batches, 2):
        out: list[tuple] = []
        for file, offset, raw in zip(*(c.to_pylist() for c in batch.columns)):
            text = raw.decode("utf-8", "replace")
            try:
                if isinstance(json.loads(text), dict):
                    out.append((file, offset, text))
            except (json.JSONDecodeError, RecursionError):
                out += [(file, offset, json.dumps(v, ensure_ascii=False)) for v in json_values(text) if isinstance(v, dict)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate([pa.string(), pa.int64(), pa.string()])], ["file", "offset", "value"])


def read_objects(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """file, offset (of the first byte), value (JSON text): the objects of all files under
    ``path``.  ``array``: a file is an array of objects (or one object); else values follow
    each other, however they are broken into lines, and those that are not objects are left out.

    Files are read twice and their fragments once more, by as many tasks as Spark cuts ranges.
    A value that doesn't parse is passed over; where its brackets never close, the rest of
    the file is read as one value, line by line.  An empty file has no value."""
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.option("lineSep", "}").text(path)
    raw = F.col("value").cast("binary").alias("raw")
    effects = lines.select(*meta, F.col("_metadata.file_size").alias("bytes"), raw).mapInArrow(_effects, _EFFECT)
    # one short row per range, so 100 bytes for 128 MB of input: small enough to be broadcast
    entries = effects.groupBy("file").applyInPandas(_compose(array), _ENTRY)
    at = shared_path(spark, "json-ranges")
    entries.write.parquet(at)
    entries = F.broadcast(spark.read.schema(entries.schema).parquet(at))
    text = lines.select(*meta, raw).join(entries, ["file", "start"]).select(*_arrow(_ENTRY).names, "raw")
    values = _values(False)
    # one worker a task finds the values and parses them
    whole = text.mapInArrow(lambda batches: _objects(values(batches)), _OBJECT)
    parts = text.mapInArrow(_values(True), _FRAGMENT).groupBy("file", "origin").agg(F.array_sort(F.collect_list(F.struct("start", "offset", "value"))).alias("parts"))
    # a value without a first part is no object
    parts = parts.filter(F.get("parts", F.lit(0))["start"] == F.col("origin"))
    joined = parts.select("file", F.get("parts", F.lit(0))["offset"].alias("offset"), F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["value"])), "")).alias("value"))
    return whole.unionByName(joined.mapInArrow(_objects, _OBJECT))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, array: bool = False, position: bool = False) -> DataFrame:
    """The objects of ``read_objects`` under ``schema``; ``position`` adds ``_file`` and ``_offset``,
    whose order is that of the values in a file."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = read_objects(spark, path, array).select("file", "offset", F.from_json("value", kind).alias("v"))
    return rows.select("v.*", *([F.col("file").alias("_file"), F.col("offset").alias("_offset")] if position else []))

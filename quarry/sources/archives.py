"""ZIP archives of any size, member by member.

Spark lists the archives without reading them.  A task reads an archive's central directory (and
ZIP64 records) in blocks and hands on one row a member: name, place, sizes, method, file mode.
Rules on names and sizes run on that index, so what they leave out is never read.  The members
are then dealt out by volume; a task seeks each one, and unpacks it block by block.

The archives must be in a file system that the tasks can open (a mounted folder, hdfs, s3, gs).
"""

from __future__ import annotations

import bz2
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a block that is read or unpacked at a time; of packed members for a reading task; of rows handed on at once.
BLOCK, TASK_BYTES, BATCH_BYTES = 1 << 20, 64 << 20, 8 << 20

_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
_INDEX = "archive string, entry long, member string, offset long, packed long, size long, method int, crc long, encrypted boolean, mode int"
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in map(str.split, ddl.split(", "))])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def open_input(uri: str) -> pa.NativeFile:
    """A seekable file of a path as Spark lists it."""
    if m := re.match(r"file:/+", uri):
        return pafs.LocalFileSystem().open_input_file("/" + uri[m.end() :])
    if uri.startswith("/"):
        return pafs.LocalFileSystem().open_input_file(uri)
    fs, path = pafs.FileSystem.from_uri(quote(uri, safe=":/@%"))
    return fs.open_input_file(path)


def _directory(f: pa.NativeFile) -> tuple[int, int, int]:
    """Place, size and shift of the central directory (shift: bytes in front of the archive)."""
    size = f.size()
    back = min(size, 65557)
    f.seek(size - back)
    tail = f.read(back)
    at = tail.rfind(_END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
        at = tail.rfind(_END, 0, at + 3)  # those bytes stand in the archive's comment
    if at < 0:
        raise ValueError("not a ZIP archive")
    length, start = struct.unpack_from("<LL", tail, at + 12)
    end = size - back + at
    if at >= 20 and tail[at - 20 : at - 16] == _LOCATOR64:
        (where,) = struct.unpack_from("<Q", tail, at - 12)
        end = end - 20 - 56
        for place in (where, end):  # the recorded place, or right before if bytes stand in front
            f.seek(max(place, 0))
            record = f.read(56)
            if record[:4] == _END64:
                end = max(place, 0)
                length, start = struct.unpack_from("<QQ", record, 40)
                break
        else:
            raise ValueError("ZIP64 record missing")
    shift = end - length - start
    if shift < 0:
        raise ValueError("central directory out of place")
    return start + shift, length, shift


def read_directory(f: pa.NativeFile, block: int = BLOCK) -> Iterator[tuple]:
    """(entry, member, offset, packed, size, method, crc, encrypted, mode), a block of the directory at a time."""
    at, left, shift = _directory(f)
    f.seek(at)
    data, n = b"", 0
    while left or data:
        while left and len(data) < 3 * 65535 + 46:  # the longest entry
            part = f.read(min(left, max(block, 3 * 65535 + 46)))
            if not part:
                raise ValueError("central directory cut off")
            left, data = left - len(part), data + part
        at = 0
        while at + 46 <= len(data):
            (sig, system, flags, method, crc, packed, size, a, b, c, attributes, offset) = struct.unpack_from("<4s1xB2xHH4xLLLHHH4xLL", data, at)
            if sig != _ENTRY:
                raise ValueError("broken entry of a central directory")
            if at + 46 + a + b + c > len(data):
                break
            name = data[at + 46 : at + 46 + a].decode("utf-8" if flags & 0x800 else "cp437", "replace")
            if 0xFFFFFFFF in (packed, size, offset):
                packed, size, offset = _extra64(data[at + 46 + a : at + 46 + a + b], packed, size, offset)
            yield n, name, offset + shift, packed, size, method, crc, bool(flags & 1), attributes >> 16 if system == 3 else 0
            n, at = n + 1, at + 46 + a + b + c
        if not at and not left and data:
            raise ValueError("broken entry of a central directory")
        data = data[at:]


def _extra64(extra: bytes, packed: int, size: int, offset: int) -> tuple[int, int, int]:
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            size = next(values) if size == 0xFFFFFFFF else size
            packed = next(values) if packed == 0xFFFFFFFF else packed
            offset = next(values) if offset == 0xFFFFFFFF else offset
            break
        at += 4 + n
    return packed, size, offset


def member_blocks(f: pa.NativeFile, member: str, offset: int, packed: int, size: int, method: int, crc: int, block: int = BLOCK) -> Iterator[bytes]:
    """A member's bytes, unpacked, at most ``block`` at a time; its size and check sum are tested."""
    f.seek(offset)
    head = f.read(30)
    if head[:4] != _LOCAL:
        raise ValueError(f"no member at the place of {member}")
    f.seek(offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
    unpack = {8: lambda: zlib.decompressobj(-15), 12: bz2.BZ2Decompressor}.get(method, lambda: None)()
    left, done, check, rest = packed, 0, 0, b""
    while True:
        if unpack is None:
            out = f.read(min(left, block))
            left -= len(out)
        else:
            if not rest and left and (method == 8 or unpack.needs_input):
                rest = f.read(min(left, block))
                left -= len(rest)
            out = unpack.decompress(rest, block) if not unpack.eof else b""
            rest = unpack.unconsumed_tail if method == 8 else b""
        if not out and (unpack is None or unpack.eof or not rest and not left):
            break
        if out:
            done, check = done + len(out), zlib.crc32(out, check)
            yield out
    if done != size or check != crc:
        raise ValueError(f"{member}: {done} bytes with check sum {check}, not {size} with {crc}")


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """One row a member of every archive under ``path``, folders and unsafe names included.
    Nothing but the central directories is read.  A file that is no archive is an error; an
    archive without members has no row."""

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with open_input(uri) as f:
                    rows = []
                    for row in read_directory(f):
                        rows.append((uri, *row))
                        if len(rows) == 10_000:
                            yield _batch(rows, _INDEX)
                            rows = []
                    yield _batch(rows, _INDEX)

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, _INDEX)


def safe_members(index: DataFrame) -> DataFrame:
    """Members that are files, without an absolute path or '..' in the name."""
    name = F.col("member")
    return index.filter(~name.endswith("/") & ~name.startswith("/") & ~name.contains(".."))


def readable_members(index: DataFrame) -> DataFrame:
    """Members that are not encrypted and packed by a known method (stored, deflate, bzip2)."""
    return index.filter(~F.col("encrypted") & F.col("method").isin(0, 8, 12))


def _dealt(index: DataFrame) -> DataFrame:
    """Members over as many tasks as their packed volume asks for."""
    volume = index.agg(F.coalesce(F.sum("packed"), F.lit(0))).first()[0]
    return index.repartition(max(1, min(100_000, -(-volume // TASK_BYTES))), "archive", "offset")


_PLACE = ["archive", "member", "offset", "packed", "size", "method", "crc"]


def _read(rows: Iterator[tuple], block: int) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    name, f = None, None
    for row in rows:
        if row[0] != name:
            if f:
                f.close()
            name, f = row[0], open_input(row[0])
        yield row, member_blocks(f, *row[1:], block=block)
    if f:
        f.close()


def read_member_blocks(index: DataFrame, block: int = BLOCK) -> DataFrame:
    """archive, member, block (from 0), content: members of any size in blocks of at most ``block`` bytes."""
    schema = "archive string, member string, block long, content binary"

    def run(batches):
        for batch in batches:
            for row, parts in _read(zip(*(c.to_pylist() for c in batch.columns)), block):
                for i, part in enumerate(parts):
                    yield _batch([(row[0], row[1], i, part)], schema)

    return _dealt(index).select(*_PLACE).mapInArrow(run, schema)


def read_members(index: DataFrame) -> DataFrame:
    """archive, member, content, size: a member is one row (under 2 GB, Spark's limit)."""
    schema = "archive string, member string, content binary, size long"

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for row, parts in _read(zip(*(c.to_pylist() for c in batch.columns)), BLOCK):
                rows.append((row[0], row[1], b"".join(parts), row[4]))
                held += row[4]
                if held >= BATCH_BYTES:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            yield _batch(rows, schema)

    return _dealt(index).select(*_PLACE).mapInArrow(run, schema)


def read_source_archives(spark: SparkSession, path: str) -> DataFrame:
    """ZIP archives -> one row per safe member: archive, member, content, size."""
    return read_members(safe_members(archive_index(spark, path)))


def ingest_archives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Archives -> source files, their functions, and the files left out with a reason.

    files: archive, rel_path, language, size, content (UTF-8, else ISO-8859-1); functions:
    archive, rel_path, uid, function_name, start_line, end_line, language, code; skipped: archive,
    path, reason ('symlink', 'too large (n bytes)', 'binary / unreadable').  The folder,
    extension and size rules run on the index.  Of members with one name the last counts, as
    when they are unpacked over each other."""
    from ..operators.corpus import SILENT_REASONS, source_file_reason
    from ..operators.segment import segment_units
    from ..functions import text as TX
    from .files import as_text
    from .fixed import INGEST_EXTENSIONS

    index = safe_members(archive_index(spark, path))
    last = index.groupBy("archive", "member").agg(F.max_by(F.struct(*[c for c in index.columns if c not in ("archive", "member")]), "entry").alias("m"))
    index = last.select("archive", "member", "m.*")
    rule = source_file_reason("member")
    silent = rule.isin(*SILENT_REASONS)
    link = F.col("mode").bitwiseAND(0o170000) == 0o120000
    unread = F.col("encrypted") | ~F.col("method").isin(0, 8, 12)
    reason = F.when(silent, rule).when(link, F.lit("symlink")).otherwise(F.coalesce(rule, F.when(unread, F.lit("binary / unreadable"))))
    marked = index.withColumn("reason", reason)
    skipped = marked.filter(F.col("reason").isNotNull() & ~F.col("reason").isin(*SILENT_REASONS)).select("archive", F.col("member").alias("path"), "reason")
    language = F.coalesce(TX.map_lookup(TX.extension("rel_path"), INGEST_EXTENSIONS), F.lit("c"))
    read = read_members(marked.filter(F.col("reason").isNull()))
    files = read.select("archive", F.col("member").alias("rel_path"), "size", as_text(F.col("content")).alias("content")).withColumn("language", language).select("archive", "rel_path", "language", "size", "content")
    # archive and member travel as one path, split again at the separator that no name has
    units = segment_units(files.select(F.concat_ws("\0", "archive", "rel_path").alias("path"), "content"))
    part = F.split("file_path", "\0")
    units = units.select(F.get(part, F.lit(0)).alias("archive"), F.get(part, F.lit(1)).alias("rel_path"), "function_name", "start_line", "end_line", "code").withColumn("language", language)
    uid = F.concat_ws("::", "rel_path", "function_name", F.col("start_line").cast("string"))
    return files, units.withColumn("uid", uid).select("archive", "rel_path", "uid", "function_name", "start_line", "end_line", "language", "code"), skipped


def write_archives(df: DataFrame, root: str) -> int:
    """Rows (archive, member, content, mode) as deflated ZIP archives under ``root``, a shared
    folder; an archive's members meet in one task.  Returns the number of archives."""
    from .files import write_file

    def pack(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("member", "content", "mode"))))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for member, content, mode in rows:
                info = zipfile.ZipInfo(member)
                info.create_system, info.external_attr = 3, mode << 16
                z.writestr(info, content, zipfile.ZIP_DEFLATED)
        fs, base = pafs.FileSystem.from_uri(root)
        write_file(fs, f"{base}/{t.column('archive')[0].as_py()}", out.getbuffer())
        return pa.table({"n": [1]})

    rows = df.select("archive", "member", F.col("content").cast("binary"), F.col("mode").cast("int"))
    # an archive is written where it is packed: none is handed on
    return rows.groupBy("archive").applyInArrow(pack, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

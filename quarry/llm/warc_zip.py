"""WARC records in ZIP packages.

Writing: every partition of pages becomes one ZIP package in the shared folder with two
stored members, ``archive/data.warc.gz`` (a gzip member per record) and
``indexes/index.cdxj`` (a JSON line per record: id, offset, length).  Equal payloads of at
least 100 bytes are written once; the others revisit the record of the smallest page_id.

Reading: ``list_members`` finds the end record, the ZIP64 locator and directory and parses
the central directory by range reads; ``index_records`` reads the index members (JSON lines, CDXJ or
CDX, gzipped or not), scans data members that no index names, and gives a row per record with its place in the package; ``read_records`` sorts these by place
and range-reads them, so one big package is shared by many tasks and nothing is extracted.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import create_file, hot_join, open_fs, settle, table, text_slices
from quarry.session import shared_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MIN_REVISIT = 100
#: Bytes of a package that one read task takes at a time.
RANGE_BYTES = 8 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


# --- deduplication ------------------------------------------------------------------------


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (the page a revisit
    names, else null).  Null html is empty; of rows that share the smallest page_id each is
    a response; a group whose page_ids are all null has no record to name, so each is a
    response."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    big = rows.filter(F.col("payload_bytes") >= MIN_REVISIT)
    groups = big.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL")
    groups = settle(groups, "warc-groups").select(F.col("payload_digest").alias("digest"), "first", "n")
    keyed = rows.withColumn("digest", F.when(F.col("payload_bytes") >= MIN_REVISIT, F.col("payload_digest")))
    joined = hot_join(keyed, groups, "digest", [F.col("page_id"), F.col("url")], "first", "n")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to"))


# --- writing --------------------------------------------------------------------------------


def warc_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode(), b"WARC-Date: 2000-01-01T00:00:00Z",
            b"WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "").encode(), b"WARC-Payload-Digest: sha256:" + digest.encode(), b"X-Payload-Length: %d" % len(payload)]
    block = _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        head.append(b"Content-Type: application/http; msgtype=response")
        block += payload
    else:
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"Content-Type: application/http; msgtype=response"]
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_packages(records: DataFrame, folder: str) -> DataFrame:
    """One package per partition with rows; returns path, n_records.  A package has a name of
    its own, so a task that runs again writes another file and only the returned ones count.
    Memory holds a batch and the index lines of one package."""

    def run(batches):
        zf, stack, path, lines, at = None, [], None, [], 0
        for batch in text_slices(batches, 2):
            for page_id, url, payload, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if zf is None:
                    path = f"{folder}/{uuid.uuid4().hex}.zip"
                    stack = [create_file(path)]
                    zf = zipfile.ZipFile(_Unseekable(stack[0].__enter__()), "w", zipfile.ZIP_STORED)
                    member = zf.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
                packed = zlib.compress(warc_record(page_id, url, payload, digest, refers), 1, wbits=31)
                member.write(packed)
                lines.append(json.dumps({"id": page_id, "file": DATA, "offset": at, "length": len(packed)}))
                at += len(packed)
        if zf is not None:
            member.close()
            with zf.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as out:
                for x in lines:
                    out.write(x.encode() + b"\n")
            zf.close()
            stack[0].__exit__(None, None, None)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(lines)], pa.int64())], ["path", "n_records"])

    return records.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(run, "path string, n_records long")


class _Unseekable:
    """What zipfile needs of a stream that can't go back."""

    def __init__(self, out):
        self.out = out

    def write(self, b):
        self.out.write(b)
        return len(b)

    def flush(self):
        self.out.flush()

    def tell(self):
        raise OSError("a stream")


# --- reading ZIP directories ------------------------------------------------------------------

_EOCD, _EOCD64, _LOC64, _CEN, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def _at(f, offset: int, n: int) -> bytes:
    f.seek(offset)
    return f.read(n)


def find_directory(f, size: int) -> tuple[int, int, int]:
    """Offset, bytes and entries of the central directory, through ZIP64 where there is one."""
    tail_at = max(0, size - 65_557)
    tail = _at(f, tail_at, size - tail_at)
    i = tail.rfind(_EOCD)
    while i >= 0 and (i + 22 > len(tail) or i + 22 + struct.unpack_from("<H", tail, i + 20)[0] != len(tail)):
        i = tail.rfind(_EOCD, 0, i)
    if i < 0:
        raise ValueError("not a ZIP package: no end record")
    entries, length, offset = struct.unpack_from("<HII", tail, i + 10)
    if entries == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        locator = _at(f, tail_at + i - 20, 20)
        if locator[:4] == _LOC64:
            end64 = _at(f, struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != _EOCD64:
                raise ValueError("ZIP64 locator points to no end record")
            entries, length, offset = struct.unpack_from("<QQQ", end64, 32)
    return offset, length, entries


def list_members(f, size: int) -> Iterator[dict]:
    """Members as the central directory has them: name, method, length, local (offset of the
    local header).  The directory is read in blocks, whatever its size."""
    offset, length, entries = find_directory(f, size)
    buf, pos, at = b"", 0, offset

    def need(n: int) -> None:
        nonlocal buf, pos, at
        if len(buf) - pos < n:
            more = _at(f, at, min(offset + length - at, max(n, 1 << 20)))
            at += len(more)
            buf, pos = buf[pos:] + more, 0
            if len(buf) < n:
                raise ValueError("central directory is cut off")

    for _ in range(entries):
        need(46)
        if buf[pos : pos + 4] != _CEN:
            raise ValueError("central directory is broken")
        method, = struct.unpack_from("<H", buf, pos + 10)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", buf, pos + 20)
        local, = struct.unpack_from("<I", buf, pos + 42)
        need(46 + n_name + n_extra + n_comment)
        name = buf[pos + 46 : pos + 46 + n_name].decode("utf-8", "replace")
        extra, i = buf[pos + 46 + n_name : pos + 46 + n_name + n_extra], 0
        while i + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, i)
            if tag == 1:  # the fields that are full, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, i + 4))
                if full == 0xFFFFFFFF:
                    full = wide.pop(0)
                if packed == 0xFFFFFFFF:
                    packed = wide.pop(0)
                if local == 0xFFFFFFFF:
                    local = wide.pop(0)
            i += 4 + n
        pos += 46 + n_name + n_extra + n_comment
        yield {"name": name, "method": method, "length": packed, "full": full, "local": local}


def data_offset(f, member: dict) -> int:
    """Where the bytes of a stored member start."""
    head = _at(f, member["local"], 30)
    if head[:4] != _LOCAL:
        raise ValueError(f"no local header for {member['name']}")
    if member["method"] != 0:
        raise ValueError(f"{member['name']} is compressed: its records can't be range-read")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member["local"] + 30 + n_name + n_extra


def member_chunks(f, m: dict) -> Iterator[bytes]:
    """Bytes of a member in pieces of 1 MB; deflated ones are unpacked (indexes may be)."""
    start, left = data_offset(f, m | {"method": 0}), m["length"]
    if m["method"] not in (0, 8):
        raise ValueError(f"{m['name']} is packed by method {m['method']}")
    unpack = zlib.decompressobj(-15) if m["method"] == 8 else None
    while left:
        chunk = _at(f, start, min(left, 1 << 20))
        start, left = start + len(chunk), left - len(chunk)
        yield unpack.decompress(chunk) if unpack else chunk


def gunzip(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Unpacked bytes of gzip members that follow each other."""
    d = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            yield d.decompress(chunk)
            chunk = d.unused_data
            if d.eof:
                d = zlib.decompressobj(31)


def text_lines(chunks: Iterator[bytes]) -> Iterator[bytes]:
    rest = b""
    for chunk in chunks:
        lines = (rest + chunk).split(b"\n")
        rest = lines.pop()
        yield from lines
    if rest:
        yield rest


def parse_index(lines: Iterator[bytes]) -> Iterator[tuple[str, int, int]]:
    """(file, offset, length) of index lines: JSON, ``key timestamp JSON``, or columns named by a
    `` CDX`` header (g: file, V: offset, S: length).  Any other line is an error."""
    letters: list[str] = []
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r")
        if text.startswith(" CDX "):
            letters = text.split()[1:]
        elif "{" in text:
            x = json.loads(text[text.index("{") :])
            if "offset" in x:
                yield str(x.get("file") or x["filename"]), int(x["offset"]), int(x["length"])
        elif letters and text.strip():
            row = dict(zip(letters, text.split()))
            yield row["g"], int(row["V"]), int(row["S"])
        elif text.strip():
            raise ValueError(f"index line not understood: {text[:80]!r}")


def scan_records(f, start: int, length: int, packed: bool) -> Iterator[tuple[int, int]]:
    """(offset, length) of the records of a data member that no index names, by reading it: gzip
    members, or records of the length that their header states."""
    pos, end = start, start + length
    while pos < end:
        at = pos
        if packed:
            d = zlib.decompressobj(31)
            while not d.eof:
                chunk = _at(f, at, min(1 << 20, end - at)) if at < end else b""
                if not chunk:
                    raise ValueError("gzip member cut off")
                at += len(chunk)
                while chunk and not d.eof:  # what it unpacks to is thrown away, 1 MB at a time
                    d.decompress(chunk, 1 << 20)
                    chunk = d.unconsumed_tail
            at -= len(d.unused_data)
        else:
            head = b""
            while b"\r\n\r\n" not in head:
                more = _at(f, pos + len(head), min(1 << 16, end - pos - len(head))) if pos + len(head) < end else b""
                if not more:
                    raise ValueError("record without an end of its header")
                head += more
            n = head.index(b"\r\n\r\n") + 4
            at = min(end, pos + n + int(header_fields(head[: n - 4])["content-length"]) + 4)
        yield pos - start, at - pos
        pos = at


def index_lines(path: str) -> Iterator[dict]:
    """Records of a package: offset in the package, length; from its index members, plain or
    gzipped, and for data members that none of them names by reading those.  An index that
    can't be read or names a member that isn't there is an error."""
    fs, p = open_fs(path)
    with fs.open_input_file(p) as f:
        members = {m["name"]: m for m in list_members(f, f.size())}
        bases: dict[str, tuple[str, int]] = {}

        def place(name: str) -> int:
            if name not in bases:
                found = next((x for x in (name, f"archive/{name}") if x in members), None)
                if found is None:
                    raise ValueError(f"{path}: an index names {name}, which is not in the package")
                bases[name] = (found, data_offset(f, members[found]))
            return bases[name][1]

        for name, m in members.items():
            if name.startswith("indexes/") and re.search(r"\.(cdxj?|json)(\.gz)?$", name):
                chunks = member_chunks(f, m)
                for file, offset, length in parse_index(text_lines(gunzip(chunks) if name.endswith(".gz") else chunks)):
                    yield {"path": path, "offset": place(file) + offset, "length": length}
        named = {found for found, _ in bases.values()}
        for name, m in members.items():
            if re.search(r"\.warc(\.gz)?$", name) and name not in named:
                base = data_offset(f, m)
                for offset, length in scan_records(f, base, m["length"], name.endswith(".gz")):
                    yield {"path": path, "offset": base + offset, "length": length}


def _tasks(df: DataFrame) -> int:
    """A number of tasks given outright: rows here are small and what they point to is not, so
    their own size must not decide."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def index_records(packages: DataFrame) -> DataFrame:
    """path -> path, offset, length of every record."""
    kinds = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for x in index_lines(path):
                    rows.append(x)
                    if len(rows) == 50_000:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    return packages.select("path").repartition(_tasks(packages), "path").mapInArrow(run, "path string, offset long, length long")


# --- reading records ----------------------------------------------------------------------------


def header_fields(head: bytes) -> dict[str, str]:
    """Fields of a WARC header, names in lower case."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse_record(raw: bytes) -> dict:
    """Header fields, and the payload: the block, without the HTTP header if it has one."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = header_fields(head)
    n = int(fields["content-length"])
    if len(block) < n:
        raise ValueError(f"record of {len(block)} bytes, not {n}")
    block = block[:n]
    http = fields.get("content-type", "").startswith("application/http")
    return {"fields": fields, "payload": block.partition(b"\r\n\r\n")[2] if http else block}


def stated_digest(fields: dict[str, str]) -> str | None:
    """Bare lower-case hex SHA-256 that a header states, if it does."""
    m = re.fullmatch(r"sha-?256:([0-9a-fA-F]{64})", fields.get("warc-payload-digest", ""))
    return m[1].lower() if m else None


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of any kind by range reads: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, record_id, and the payload on request.  page_id and refers_to are those of
    records that ``write_packages`` wrote, else null.  Length and digest are those of the bytes
    read; a mismatch with what the header states is an error.  A revisit has no bytes, so they
    are those of its header, null if it states none."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"] + ["payload"] * with_payload
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string())] + [("payload", pa.binary())] * with_payload)

    def page(urn: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", urn or "")
        return int(m[1]) if m else None

    def run(batches):
        f, opened = None, None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if path != opened:
                    if f is not None:
                        f.close()
                    fs, p = open_fs(path)
                    f, opened = fs.open_input_file(p), path
                raw = _at(f, offset, length)
                x = parse_record(zlib.decompress(raw, wbits=31) if raw[:2] == b"\x1f\x8b" else raw)
                h = x["fields"]
                digest, stated = stated_digest(h), h.get("x-payload-length")
                n = int(stated) if stated else None
                if h["warc-type"] != "revisit":
                    real = (hashlib.sha256(x["payload"]).hexdigest(), len(x["payload"]))
                    if digest not in (None, real[0]) or n not in (None, real[1]):
                        raise ValueError(f"payload of {h.get('warc-record-id')} doesn't match its digest")
                    digest, n = real
                row = [page(h.get("warc-record-id")), h.get("warc-target-uri"), n, digest, h["warc-type"], page(h.get("warc-refers-to")), h.get("warc-record-id")]
                rows.append(dict(zip(names, row + [x["payload"]] * with_payload)))
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kinds)
        if f is not None:
            f.close()

    block = F.floor(F.col("offset") / RANGE_BYTES)
    ordered = index.withColumn("block", block).repartition(_tasks(index), "path", "block").sortWithinPartitions("path", "offset")
    return ordered.select("path", "offset", "length").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string" + ", payload binary" * with_payload)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write packages of ``pages`` (page_id, url, html) to a shared folder; returns path and
    n_records, settled, so that the packages are written once."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    return settle(write_packages(plan_records(pages), folder), "warc-manifest")


def op4_zip_archives(spark, sf_dir: str) -> DataFrame:
    """Every page written to a WARC record in a ZIP package and read back."""
    packages = archive_pages(table(spark, sf_dir, "pages"))
    return read_records(index_records(packages)).drop("url", "record_id")


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM g
"""

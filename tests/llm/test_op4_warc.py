import gzip
import hashlib
import io
import struct
import zipfile

import pytest

from quarry.llm import warc_zip as W

S = "page_id long, url string, html string"
LONG = "<p>" + "é" * 60


def test_edge_cases(spark):
    rows = [(5, "http://a b\r\n/x", LONG), (3, None, LONG), (3, "u", LONG), (9, "v", LONG), (None, "w", LONG), (1, "x", None), (2, "x", ""), (4, "y", "short"), (6, "y", "short"), (7, "z", "a\r\n\r\nb" * 100_000), (8, "n" * 5, "\x00" * 100)]
    pages = spark.createDataFrame(rows, S).repartition(3).withColumnRenamed("url", "url").selectExpr("*", "1 AS payload", "2 AS digest")
    got = sorted((r.asDict() for r in W.read_records(W.index_records(W.archive_pages(pages)), with_payload=True).collect()), key=lambda r: (r["page_id"] is None, r["page_id"] or 0, r["url"]))
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    for i, u, h in rows:
        raw = (h or "").encode()
        r = by[i][0]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha256(raw).hexdigest()
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == raw
    assert [r["record_type"] for r in by[3]] == ["response"] * 2
    assert [(by[i][0]["record_type"], by[i][0]["refers_to"]) for i in (5, 9, None)] == [("revisit", 3)] * 3
    assert {by[i][0]["record_type"] for i in (1, 2, 4, 6, 7, 8)} == {"response"}
    assert by[5][0]["url"] == "http://a%20b%0D%0A/x"


def test_empty_table(spark):
    pages = spark.createDataFrame([], S)
    assert W.read_records(W.index_records(W.archive_pages(pages))).collect() == []


def build(names, comment=b""):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED) as z:
        for n in names:
            z.writestr(n, n * 3)
        z.comment = comment
    return buf


def test_central_directory_and_comment():
    names = [f"é{i}" for i in range(30)]
    buf = build(names, b"PK\x05\x06 not the end" + b" " * 100)
    members = list(W.list_members(buf, len(buf.getvalue())))
    assert [m["name"] for m in members] == names
    for m in members:
        at = W.data_offset(buf, m)
        assert buf.getvalue()[at : at + m["length"]].decode() == m["name"] * 3


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 5)
    names = [f"n{i}" * 20 for i in range(20)]
    buf = build(names)
    raw = buf.getvalue()
    assert b"PK\x06\x06" in raw and b"PK\x06\x07" in raw
    # the end record as a package over the limits has it
    i = raw.rfind(b"PK\x05\x06")
    raw = raw[: i + 8] + struct.pack("<HHII", 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF) + raw[i + 20 :]
    f = io.BytesIO(raw)
    members = list(W.list_members(f, len(raw)))
    assert [m["name"] for m in members] == names
    for m in members:
        at = W.data_offset(f, m)
        assert raw[at : at + m["length"]].decode() == m["name"] * 3


def test_broken_packages():
    for raw in (b"", b"PK\x05\x06", b"x" * 100):
        with pytest.raises(ValueError):
            W.find_directory(io.BytesIO(raw), len(raw))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "b" * 100)
    with pytest.raises(ValueError, match="compressed"):
        W.data_offset(buf, next(W.list_members(buf, len(buf.getvalue()))))


def record(kind, uri, block, extra="", ctype="application/http; msgtype=response", uid="urn:uuid:1"):
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{uid}>\r\n" + (f"WARC-Target-URI: {uri}\r\n" if uri else "") + f"Content-Type:{ctype}\r\nContent-Length: {len(block)}\r\n{extra}\r\n"
    return head.encode() + block + b"\r\n\r\n"


def foreign(tmp_path, name, index, data="a.warc.gz", deflate_index=False):
    """A package as other tools write them: a warcinfo, a response without a digest, a revisit."""
    raw = [record("warcinfo", None, b"software: x", ctype="application/warc-fields"), record("response", "http://a/", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>one</p>"), record("revisit", "http://b/", b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Payload-Digest: sha1:ABC\r\n"), record("resource", "http://c/", b"x\r\n\r\ny" * 30_000, ctype="text/plain")]
    packed = [gzip.compress(x) if data.endswith(".gz") else x for x in raw]
    at = [sum(map(len, packed[:i])) for i in range(len(packed))]
    with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}")
        z.writestr(f"archive/{data}", b"".join(packed))
        for member, text in index(data, at, list(map(len, packed))).items():
            z.writestr(member, text, zipfile.ZIP_DEFLATED if deflate_index else zipfile.ZIP_STORED)


def cdxj(file, at, size):
    return "".join(f'com,a)/ 2024 {{"url": "u", "filename": "{file}", "offset": "{o}", "length": "{n}"}}\n' for o, n in zip(at, size)).encode()


@pytest.mark.parametrize("kind", ["cdxj", "cdx.gz", "deflated", "cdx", "none", "plain"])
def test_foreign_packages(spark, tmp_path, kind):
    index = {
        "cdxj": lambda f, o, n: {"indexes/index.cdxj": cdxj(f, o, n)},
        "cdx.gz": lambda f, o, n: {"indexes/index.cdx.gz": gzip.compress(cdxj(f, o[:2], n[:2])) + gzip.compress(cdxj(f, o[2:], n[2:])), "indexes/index.idx": b"key 0 1"},
        "deflated": lambda f, o, n: {"indexes/index.cdxj": cdxj("archive/" + f, o, n)},
        "cdx": lambda f, o, n: {"indexes/index.cdx": (" CDX N S V g\n" + "".join(f"k {b} {a} {f}\n" for a, b in zip(o, n))).encode()},
        "none": lambda f, o, n: {},
        "plain": lambda f, o, n: {},
    }[kind]
    foreign(tmp_path, "p.wacz", index, "a.warc" if kind == "plain" else "a.warc.gz", kind == "deflated")
    packages = spark.createDataFrame([((tmp_path / "p.wacz").as_uri(),)], "path string")
    got = sorted((r.record_type, r.url, r.payload_bytes, bytes(r.payload)[:10], r.page_id) for r in W.read_records(W.index_records(packages), with_payload=True).collect())
    big = b"x\r\n\r\ny" * 30_000
    assert got == [("resource", "http://c/", len(big), big[:10], None), ("response", "http://a/", 10, b"<p>one</p>", None), ("revisit", "http://b/", None, b"", None), ("warcinfo", None, 11, b"software: ", None)]


@pytest.mark.parametrize("line", [b"nonsense\n", b'k 1 {"filename": "gone.warc.gz", "offset": 0, "length": 9}\n', b'{"file": 1, "offset": }\n'])
def test_what_cannot_be_read_is_an_error(spark, tmp_path, line):
    foreign(tmp_path, "p.wacz", lambda f, o, n: {"indexes/index.cdxj": line})
    packages = spark.createDataFrame([((tmp_path / "p.wacz").as_uri(),)], "path string")
    with pytest.raises(Exception):
        W.read_records(W.index_records(packages)).collect()


def test_cut_off_data_is_an_error():
    whole = gzip.compress(record("resource", "u", b"x" * 1000))
    assert list(W.scan_records(io.BytesIO(whole * 2), 0, 2 * len(whole), True)) == [(0, len(whole)), (len(whole), len(whole))]
    with pytest.raises(ValueError):
        list(W.scan_records(io.BytesIO(whole), 0, len(whole) - 5, True))

"""Archives of every shape, read through their directories."""

import io
import os
import random
import struct
import zipfile

import pytest

from quarry.sources import archives as A
from quarry.sources import files as FS


def pack(members, method=zipfile.ZIP_DEFLATED, prefix=b"", comment=b"", modes=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members:
            info = zipfile.ZipInfo(name)
            info.create_system, info.external_attr, info.compress_type = 3, (modes or {}).get(name, 0o100644) << 16, method
            z.writestr(info, data)
        z.comment = comment
    return prefix + out.getvalue()


def rows(spark, path):
    return sorted((r.archive.rsplit("/", 1)[-1], r.member, bytes(r.content), r.size) for r in A.read_source_archives(spark, str(path)).collect())


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2])
def test_members(spark, tmp_path, method):
    rng = random.Random(method)
    members = [(f"d/{i} é.c", rng.randbytes(rng.choice([0, 1, 70_000])) + b"x" * rng.choice([0, 200_000])) for i in range(20)]
    (tmp_path / "a b.zip").write_bytes(pack([*members, ("/abs.c", b"1"), ("../up.c", b"2"), ("dir/", b""), ("a/..b", b"3")], method))
    (tmp_path / "front.zip").write_bytes(pack(members[:3], method, prefix=b"#!/bin/sh\n" + b"PK\5\6" * 9, comment=b"a comment PK\5\6"))
    (tmp_path / "empty.zip").write_bytes(pack([]))
    want = [("a b.zip", n, d, len(d)) for n, d in members] + [("front.zip", n, d, len(d)) for n, d in members[:3]]
    assert rows(spark, tmp_path) == sorted(want)


def test_zip64_records_and_many_members(spark, tmp_path):
    """Over 65,535 members make the writer use ZIP64 records; sizes in the extra field are forced."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(66_000):
            z.writestr(f"{i}.c", b"%d" % i)
    (tmp_path / "many.zip").write_bytes(out.getvalue())
    got = A.archive_index(spark, str(tmp_path / "many.zip"))
    assert got.count() == 66_000 and got.filter("entry = 65999").first().member == "65999.c"
    some = A.read_members(got.filter("entry % 10000 = 7")).collect()
    assert sorted((r.member, bytes(r.content)) for r in some) == sorted((f"{i}.c", b"%d" % i) for i in range(7, 66_000, 10_000))
    extra = struct.pack("<HHQQQ", 1, 24, 5, 6, 7)
    assert A._extra64(struct.pack("<HH", 9, 2) + b"ab" + extra, 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF) == (6, 5, 7)
    assert A._extra64(extra, 3, 0xFFFFFFFF, 4) == (3, 5, 4)


def test_directory_in_small_blocks(tmp_path):
    p = tmp_path / "a.zip"
    p.write_bytes(pack([(f"n{i}" * 50, b"x") for i in range(3000)]))
    with A.open_input(str(p)) as f:
        assert [r[1] for r in A.read_directory(f, block=1)] == [f"n{i}" * 50 for i in range(3000)]


def test_blocks_of_a_large_member(spark, tmp_path):
    data = os.urandom(300_000) + b"\0" * 700_000
    (tmp_path / "a.zip").write_bytes(pack([("big", data), ("none", b"")]))
    got = A.read_member_blocks(A.archive_index(spark, str(tmp_path)), block=64_000).orderBy("block").collect()
    assert max(len(r.content) for r in got) <= 64_000 and b"".join(bytes(r.content) for r in got) == data
    assert [r.block for r in got] == list(range(len(got)))


@pytest.mark.parametrize("what", ["no archive", "cut", "directory", "flipped", "entry"])
def test_broken_archives_are_errors(spark, tmp_path, what):
    good = pack([("a.c", b"hello " * 1000)])
    bad = {"no archive": b"this is no archive", "cut": good[:-30], "directory": good.replace(b"PK\1\2", b"PK\1\3"), "flipped": good[:40] + bytes([good[40] ^ 255]) + good[41:], "entry": good.replace(b"PK\3\4", b"PK\3\5")}
    (tmp_path / "a.zip").write_bytes(bad[what])
    with pytest.raises(Exception):
        rows(spark, tmp_path)


def test_ingestion(spark, tmp_path):
    code = "int add(int a, int b)\n{\n return a + b;\n}\n"
    members = [("src/a.c", code.encode()), ("src/b.CPP", b"void A::f() { } // \xe9"), ("src/c.h", b""), ("README.md", b"x"), (".git/x.c", code.encode()), ("a/build/y.c", code.encode()),
               ("big.c", b"/" * (1024 * 1024 + 1)), ("link.c", b"src/a.c"), ("dup.c", b"int old() { }"), ("dup.c", b"int new_one() { }"), ("main.py", b"x")]
    (tmp_path / "a.zip").write_bytes(pack(members, modes={"link.c": 0o120777}))
    locked = bytearray(pack([("locked.c", b"int x() { }"), ("open.c", b"int y() { }")]))
    at = locked.index(b"PK\1\2")
    locked[at + 8] |= 1  # the directory's flag of encryption
    (tmp_path / "b.zip").write_bytes(bytes(locked))
    files, functions, skipped = A.ingest_archives(spark, str(tmp_path))
    got = sorted((r.archive[-5:], r.rel_path, r.language, r.size, r.content) for r in files.collect())
    assert got == [("a.zip", "dup.c", "c", 17, "int new_one() { }"), ("a.zip", "src/a.c", "c", len(code), code), ("a.zip", "src/b.CPP", "cpp", 20, "void A::f() { } // é"), ("a.zip", "src/c.h", "c", 0, ""), ("b.zip", "open.c", "c", 11, "int y() { }")]
    units = sorted((r.rel_path, r.uid, r.function_name, r.start_line, r.end_line, r.language) for r in functions.collect())
    assert units == [("dup.c", "dup.c::new_one::1", "new_one", 1, 1, "c"), ("open.c", "open.c::y::1", "y", 1, 1, "c"), ("src/a.c", "src/a.c::add::1", "add", 1, 4, "c"), ("src/b.CPP", "src/b.CPP::A::f::1", "A::f", 1, 1, "cpp")]
    assert sorted((r.path, r.reason) for r in skipped.collect()) == [("big.c", "too large (1,048,577 bytes)"), ("link.c", "symlink"), ("locked.c", "binary / unreadable")]


def test_left_out_members_are_not_read(spark, tmp_path):
    """A member whose data are broken is no error if a rule on the index leaves it out."""
    data = pack([("build/a.c", b"hello " * 1000), ("ok.c", b"int f() { }")])
    (tmp_path / "a.zip").write_bytes(data[:45] + bytes([data[45] ^ 255]) + data[46:])
    files, _, _ = A.ingest_archives(spark, str(tmp_path))
    assert [r.rel_path for r in files.collect()] == ["ok.c"]
    assert FS.read_source_archives is A.read_source_archives


def test_tree_with_links_and_unreadable_files(spark, tmp_path, monkeypatch):
    for name in ("a.c", "src/b.H", "src/deep/c.cpp", "build/x.c", ".git/y.c", "notes.txt", "gone.c"):
        p = tmp_path / "t" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("int f() { }")
    (tmp_path / "t/big.c").write_bytes(b"/" * (1024 * 1024 + 1))
    (tmp_path / "t/l.c").symlink_to(tmp_path / "t/a.c")
    (tmp_path / "t/broken.c").symlink_to(tmp_path / "nowhere")
    (tmp_path / "t/folder.c").symlink_to(tmp_path / "t/src")
    accepted, skipped = FS.source_tree_status(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, accepted.collect())) == [("a.c", "c", 11), ("gone.c", "c", 11), ("src/b.H", "c", 11), ("src/deep/c.cpp", "cpp", 11)]
    assert sorted(map(tuple, skipped.collect())) == [("big.c", "too large (1,048,577 bytes)"), ("broken.c", "symlink"), ("l.c", "symlink")]
    # a file that may not be read (this test may run as a user who may read all)
    rows = spark.createDataFrame([("a.c", "file", 3, False), ("b.txt", "file", 3, False), ("c.c", "link", 3, False)], FS._STATUS)
    monkeypatch.setattr(FS, "list_file_status", lambda *a: rows)
    accepted, skipped = FS.source_tree_status(spark, "x")
    assert accepted.collect() == [] and sorted(map(tuple, skipped.collect())) == [("a.c", "binary / unreadable"), ("c.c", "symlink")]


def test_an_empty_tree(spark, tmp_path):
    assert FS.source_tree_status(spark, str(tmp_path))[0].collect() == []


def test_archives_are_written_where_they_are_packed(spark, tmp_path, monkeypatch):
    def handed_on(df, root):
        raise AssertionError("packed archives are handed on to other tasks")

    monkeypatch.setattr(FS, "write_files", handed_on)
    docs = spark.range(40).selectExpr("concat('sub/a', id div 10, '.zip') AS archive", "concat('m', id) AS member", "repeat('x', int(id)) AS content", "33188 AS mode")
    assert A.write_archives(docs, f"file://{tmp_path}") == 4
    got = rows(spark, tmp_path / "sub/*.zip")
    assert got == sorted((f"a{i // 10}.zip", f"m{i}", b"x" * i, i) for i in range(40))

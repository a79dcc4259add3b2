"""Files cut into ranges of a few bytes give the values that one pass gives."""

import gzip
import json
import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.sources import files as FS
from quarry.sources import json_ranges as J


@pytest.fixture
def tiny(spark):
    """Ranges of a few bytes (several thousand for the files of a test)."""

    def cut(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield cut
    for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{k}")


TEXTS = ["", "}", '"', "\\", '\\"}', "a}{[", "x\ny", "é日", "\\\\", "]]", "{" * 9, "\t\x01", " " * 30]


def some(rng, depth=0):
    kind = rng.randint(0, 5 if depth < 3 else 3)
    if kind < 4:
        return rng.choice([*TEXTS, None, True, -1.5e3, 12])
    if kind == 4:
        return [some(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(TEXTS): some(rng, depth + 1) for _ in range(rng.randint(0, 3))}


def dump(rng, v):
    return json.dumps(v, indent=rng.choice([None, None, 1, "\t"]), ensure_ascii=rng.random() < 0.5, separators=rng.choice([None, (",", ":")]))


def by_file(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.offset):
        out.setdefault(r.file.rsplit("/", 1)[-1], []).append((r.offset, r.value))
    return out


@pytest.mark.parametrize("seed,n", [(1, 7), (2, 23), (3, 64), (4, 1 << 20)])
def test_concatenated_values(spark, tmp_path, tiny, seed, n):
    rng, want = random.Random(seed), {}
    for f in range(12):
        text, objects = "", []
        for _ in range(rng.randint(0, 12)):
            v = rng.choice([some(rng), {"k": some(rng), "i": f}])
            if isinstance(v, dict):
                objects.append((len(text.encode()), v))
            text += dump(rng, v) + rng.choice([" ", "\n", "\n\n", "\r\n"])
        text = text if rng.random() < 0.5 else text.rstrip()
        (tmp_path / f"{f}.json").write_bytes(text.encode())
        if objects:
            want[f"{f}.json"] = objects
    tiny(n)
    got = by_file(J.read_objects(spark, str(tmp_path)).collect())
    assert {k: [(o, json.loads(v)) for o, v in rows] for k, rows in got.items()} == want


@pytest.mark.parametrize("seed,n", [(5, 9), (6, 40)])
def test_arrays(spark, tmp_path, tiny, seed, n):
    rng, want = random.Random(seed), {}
    for f in range(10):
        values = [rng.choice([some(rng), {"k": some(rng)}]) for _ in range(rng.randint(0, 15))]
        (tmp_path / f"{f}.json").write_text(dump(rng, values) + rng.choice(["", "\n"]), encoding="utf-8", newline="")
        if any(isinstance(v, dict) for v in values):
            want[f"{f}.json"] = [v for v in values if isinstance(v, dict)]
    (tmp_path / "one.json").write_text('{"a": {"b": [{"c": 1}]}}')
    tiny(n)
    got = by_file(J.read_objects(spark, str(tmp_path), array=True).collect())
    assert {k: [json.loads(v) for _, v in rows] for k, rows in got.items()} == want | {"one.json": [{"a": {"b": [{"c": 1}]}}]}


@pytest.mark.parametrize("n", [5, 17, 1 << 20])
def test_broken_values(spark, tmp_path, tiny, n):
    cases = {
        "unclosed": '{"a": 1}\n{"a": 2\n{"a": 3}\n{"a": 4}\n',
        "truncated": '{"a": 1}\n{"a": 2',
        "truncated_deep": '{"a": 1}\n{"b": {"a": 2}',
        "quote": '{"a": "x\n{"a": 5}\n',
        "closers": '}} ]{"a": 6} }\n{"a": 7}',
        "bad": '{"a": }\n{"a": 8}\n{a}\n{"a": 9}',
        "array": '[{"a": 0}]\n{"a": 10}[1, {"a": 0}] {"a": 11}',
        "empty": "",
        "blank": " \n\n",
        "latin": b'{"a": 12, "b": "\xe9"}\n',
    }
    for k, v in cases.items():
        (tmp_path / k).write_bytes(v if isinstance(v, bytes) else v.encode())
    tiny(n)
    got = {k: [json.loads(v).get("a") for _, v in rows] for k, rows in by_file(J.read_objects(spark, str(tmp_path)).collect()).items()}
    assert got == {"unclosed": [1, 3, 4], "truncated": [1], "truncated_deep": [1], "quote": [5], "closers": [6, 7], "bad": [8, 9], "array": [10, 11], "latin": [12]}


def test_compressed_file_and_schema(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write("\n".join(json.dumps({"func": "x" * 50 + "}", "target": i}) for i in range(500)) + "\n")
    rows = FS.read_raw_json_values(spark, str(tmp_path), "func string, target int, other string", position=True).orderBy("_offset").collect()
    assert [r.target for r in rows] == list(range(500)) and rows[0].other is None and rows[0].func == "x" * 50 + "}"


def test_one_file_is_read_by_many_tasks(spark, tmp_path, tiny):
    values = [{"func": "if (a) { b[%d] = \"}\"; }" % i * 20, "target": i} for i in range(20_000)]
    (tmp_path / "a.json").write_text(json.dumps(values))
    tiny(1 << 20)
    df = FS.read_raw_json_array(spark, str(tmp_path / "a.json"), "func string, target long")
    assert df.rdd.getNumPartitions() > 8
    assert sorted((r.target, r.func) for r in df.collect()) == [(v["target"], v["func"]) for v in values]


@pytest.mark.parametrize("seed", range(4))
def test_effects_compose(seed):
    """Walking two pieces one after the other is walking their effects."""
    rng = random.Random(seed)
    for _ in range(300):
        data = "".join(rng.choices('{}[]"\\\nab', weights=[3, 3, 1, 1, 3, 1, 1, 2, 2], k=rng.randint(1, 40))).encode()
        for inside in (False, True):
            # a walk, byte by byte
            state, depth, escaped, seen = inside, 3, False, []
            for i, c in enumerate(data.decode()):
                if c == "\n":
                    state = False
                elif c == '"' and not escaped:
                    state = not state
                elif c in "{}[]" and not state:
                    depth = max(0, depth + (1 if c in "{[" else -1))
                    seen.append((i, depth))
                escaped = c == "\\" and not escaped
            pos, step, out = J.Brackets(data).visible(inside)
            assert list(zip(pos.tolist(), J._depths(step, 3).tolist())) == seen and bool(out) == state
            if len(step):
                total = np.cumsum(step)
                a, low = int(total[-1]), min(0, int(total.min()))
                for d in range(5):
                    assert max(d + a, a - low) == J._depths(step, d)[-1]


def test_tasks_hold_a_piece_at_a_time(monkeypatch):
    monkeypatch.setattr(J, "PIECE", 1000)
    texts = [json.dumps({"i": i, "s": "x{}" * (i % 40)}) for i in range(400)]
    parts = " ".join(texts).encode().split(b"}")[:-1]
    n = len(parts)
    longest = max(map(len, texts))
    rows = pa.RecordBatch.from_arrays([pa.array(["f"] * n), pa.array([0] * n), pa.array([False] * n), pa.array([0] * n), pa.array([0] * n),
                                       pa.array([0] * n), pa.array([-1] * n), pa.array([-1] * n), pa.array(parts, pa.binary())], [*J._arrow(J._ENTRY).names, "raw"])
    assert max(len(data) for _, data in J._pieces(iter([rows]), 8)) < 1000 + 2 * longest + n
    out = list(J._values(False)(iter([rows])))
    assert max(b.column(2).nbytes for b in out) < 3000 + 2 * longest
    assert [v.decode() for b in out for v in b.column(2).to_pylist()] == texts
    found = list(J._objects(iter([pa.Table.from_batches(out).combine_chunks().to_batches()[0]])))
    assert len(found) > 10 and [v for b in found for v in b.column(2).to_pylist()] == texts


def test_one_line_files_are_written_by_pieces(spark):
    from quarry.plans.registry import queries
    queries()  # loads the plans in their order
    from quarry.plans.q_io import _one_line

    rows = spark.range(5000, numPartitions=1).selectExpr("id AS i", "repeat('x', 2000) AS s")
    got = FS.read_raw_json_array(spark, _one_line(spark, rows, "one-line", True), "i long, s string")
    assert sorted((r.i, len(r.s)) for r in got.collect()) == [(i, 2000) for i in range(5000)]

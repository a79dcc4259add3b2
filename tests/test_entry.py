"""The entry module where the training-data subpackage is absent."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

PROBE = """
import __spark_entry__ as E
names = set(E.queries())
assert "corpus_label_mix" in names and len(names) > 140, len(names)
assert not [n for n in names if n == "pipeline" or n.startswith("op")], names
assert set(E.oracle_sql()) <= names
"""


def _copy(tmp_path, *without):
    at = tmp_path / "copy"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in without:
        path = at / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return lambda code: subprocess.run([sys.executable, "-c", code], cwd=at, env=env, capture_output=True, text=True, timeout=120)


def test_queries_without_the_subpackage(tmp_path):
    run = _copy(tmp_path, "quarry/llm", "tests/llm")
    done = run(PROBE)
    assert done.returncode == 0, done.stderr


def test_queries_without_subpackage_and_pipeline(tmp_path):
    run = _copy(tmp_path, "quarry/llm", "tests/llm", "corpus_pipeline.py")
    done = run(PROBE)
    assert done.returncode == 0, done.stderr

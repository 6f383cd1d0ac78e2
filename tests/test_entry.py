"""The entry module, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry


def test_names():
    assert {*entry.oracle_sql()} <= {*entry.queries()} and len(entry.queries()) > 70


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_optional_parts(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert got.returncode == 0, got.stderr
    n, sql = map(int, got.stdout.split())
    assert n == sql > 70

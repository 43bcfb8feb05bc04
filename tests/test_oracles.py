"""Every query with a DuckDB twin beside it, at the smallest scale; and the entry."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tools.compare import compare

NAMES = [n for n in entry.queries() if n in entry.oracle_sql()]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    ok, say = compare(spark, name, "/root/testdata/sf0.001", entry.queries()[name], entry.oracle_sql()[name])
    assert ok, say


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_corpus_operators(tmp_path):
    """With the folders of the corpus operators and the pipeline gone, the entry still imports."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top / "loam", tmp_path / "loam", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 50

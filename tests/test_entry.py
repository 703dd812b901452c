"""The driver's entry points, with and without the pipeline's operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LOOK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n == 'pipeline' or n[:2] == 'op' for n in q))"


@pytest.mark.parametrize("gone", [["codelode/llm"], ["corpus_pipeline.py"], ["codelode/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_parts(tmp_path, gone):
    """What is deleted takes only its own queries along."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md"))
    for name in gone:
        shutil.rmtree(copy / name, ignore_errors=True)
        (copy / name).unlink(missing_ok=True)
    found = subprocess.run([sys.executable, "-c", LOOK], cwd=copy, capture_output=True, text=True)
    assert found.returncode == 0, found.stderr
    total, own = map(int, found.stdout.split()[-2:])
    from codelode import catalog_queries as base

    assert total - own == len(base.QUERIES) >= 90
    assert own == 0 or "codelode/llm" not in gone

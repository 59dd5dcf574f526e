"""The driver contract, with and without the training-data subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from quillmill.plans import catalogue

REPO = Path(__file__).resolve().parent.parent


def test_all_queries_are_registered():
    found = __spark_entry__.queries()
    assert set(catalogue.QUERIES) <= set(found)
    assert set(__spark_entry__.oracle_sql()) <= set(found)
    assert catalogue.FLAGSHIP in found


def test_entry_works_without_the_subpackage(tmp_path):
    shutil.copytree(REPO / "quillmill", tmp_path / "quillmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 40 and set(q) == set(e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_subpackage():
    for file in (REPO / "quillmill").rglob("*.py"):
        if "llm" not in file.relative_to(REPO).parts:
            assert "quillmill.llm" not in file.read_text(encoding="utf-8"), file

"""The library without its corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _names(folder: str) -> set[str]:
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True)
    return set(done.stdout.split())


def test_queries_without_the_corpus_operators(tmp_path):
    """With the folders of the corpus operators gone, all other queries are still there."""
    skipped = shutil.ignore_patterns("llm", "__pycache__", ".*")
    shutil.copytree(ROOT, f"{tmp_path}/pipeline_left", ignore=skipped)
    shutil.copytree(ROOT, f"{tmp_path}/pipeline_gone", ignore=shutil.ignore_patterns("llm", "__pycache__", ".*", "corpus_pipeline.py"))
    left = _names(f"{tmp_path}/pipeline_left")
    assert left == _names(f"{tmp_path}/pipeline_gone") and len(left) > 100
    assert not [n for n in left if n == "pipeline" or n.startswith("op")]


def test_nothing_else_imports_the_corpus_operators():
    for folder, inner, files in os.walk(f"{ROOT}/tidemark"):
        inner[:] = [d for d in inner if d != "llm"]
        for name in files:
            if name.endswith(".py"):
                with open(f"{folder}/{name}") as f:
                    assert "tidemark.llm" not in f.read(), name

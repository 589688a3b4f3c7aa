"""The driver contract: the flagship query and the registry."""

import pytest

import __spark_entry__ as entry_module


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_registry():
    known = entry_module.queries()
    assert set(entry_module.oracle_sql()) <= set(known) and all(callable(f) for f in known.values())


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_imports_without_the_corpus_part(tmp_path, gone):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry_module.__file__))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and e.oracle_sql(); assert 'pipeline' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=False).returncode == 0

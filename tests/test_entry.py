"""The entry module with and without the folders that may be deleted."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark, sf_dir):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "vec_id", "distance", "rank"] and df.count() == 250


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",)])
@pytest.mark.parametrize("bytecode", [False, True])
def test_without_the_llm_folders(tmp_path, gone, bytecode):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(*gone, ".git", "__pycache__"))
    if bytecode:
        (tmp_path / "repo/orrery/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'knn_l2' in n and 'pipeline' not in n and not [k for k in n if k.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={"PATH": "/usr/bin:/bin"}, check=True)


def test_nothing_else_imports_the_llm_folder():
    for path in (ROOT / "orrery").rglob("*.py"):
        if "llm" not in path.parts:
            assert "orrery.llm" not in path.read_text(), path

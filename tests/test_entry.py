"""The contract file, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 16
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("pipeline", ["corpus_pipeline.py", "none"])
def test_without_llm(tmp_path, pipeline):
    skip = shutil.ignore_patterns("llm", pipeline, ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "r", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q_rectangle' in q and 'pipeline' not in q; assert not any(x.startswith('op1') for x in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "pointloom")):
        if "llm" not in folder.split(os.sep):
            for name in (n for n in names if n.endswith(".py")):
                with open(os.path.join(folder, name)) as f:
                    assert "llm" not in f.read(), name

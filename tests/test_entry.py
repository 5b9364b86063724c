from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def run(code: str, cwd: Path) -> str:
    done = subprocess.run([sys.executable, "-c", code], cwd=cwd, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return done.stdout


def test_imports_without_a_session():
    run("import __spark_entry__ as e; assert e.queries().keys() >= e.oracle_sql().keys()", ROOT)


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    """With their folders gone, with and without the pipeline, every other query is still there."""
    from quantrail.queries import QUERIES

    there = tmp_path / "repo"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; e.oracle_sql(); print(*sorted(e.queries()))"
    assert run(code, there).split() == sorted(QUERIES)
    (there / "corpus_pipeline.py").unlink(missing_ok=True)
    assert run(code, there).split() == sorted(QUERIES)


def test_the_rest_stands_without_what_the_training_data_operators_need():
    """A missing library takes away those operators alone, with a warning."""
    from quantrail.queries import QUERIES

    code = "import sys; sys.modules['ahocorasick'] = None; import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; e.oracle_sql(); print(*sorted(e.queries()))"
    assert run(code, ROOT).split() == sorted(QUERIES)

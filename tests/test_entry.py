"""The entry without the part on training text, or without a library that it needs."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__  # noqa: F401  (fills the registry)

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def counted(folder, before=""):
    run = subprocess.run([sys.executable, "-W", "ignore", "-c", before + COUNT], cwd=folder, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


@pytest.mark.parametrize("library", ["sentencepiece", "tokenizers", "xxhash"])
def test_a_missing_library_leaves_the_other_queries(library):
    from checks.registry import ORACLE, QUERIES

    found = counted(ROOT, f"import sys; sys.modules[{library!r}] = None; ")
    assert found == [str(len(QUERIES)), str(len(ORACLE)), "False"]


def test_without_the_part_on_training_text(tmp_path):
    from checks.registry import ORACLE, QUERIES

    copy = tmp_path / "copy"
    left_out = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(ROOT, copy, ignore=left_out)
    assert counted(copy) == [str(len(QUERIES)), str(len(ORACLE)), "False"]

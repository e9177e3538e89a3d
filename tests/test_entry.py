"""The driver contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 30


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


CODE = """
import sys
import __spark_entry__ as e
names, sql = set(e.queries()), set(e.oracle_sql())
assert "daily_summary" in names and sql <= names
assert not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
assert not any(m.startswith("runlake.llm") or m == "corpus_pipeline" for m in sys.modules)
"""


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_a_copy_without_the_optional_parts(tmp_path, pipeline_too):
    """A real copy that lacks the subpackage and its tests lists the library's queries, and its tests can be collected."""
    gone = ["runlake/llm", "tests/llm"] + ["corpus_pipeline.py"] * pipeline_too
    skip = lambda folder, names: [n for n in names if n in (".git", "__pycache__", ".pytest_cache") or str((Path(folder) / n).relative_to(ROOT)) in gone]
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=skip)
    (copy / "runlake/llm/__pycache__").mkdir(parents=True)  # what a deletion of the files alone leaves behind
    assert (copy / "corpus_pipeline.py").exists() is not pipeline_too
    own = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=own, check=True)
    subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, env=own, check=True, stdout=subprocess.DEVNULL)

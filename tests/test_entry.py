"""The entry module, with and without the operators for training data."""

import os
import shutil
import subprocess
import sys

import pytest

from tidewright.plans import registry

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LISTS = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), len(e.oracle_sql()), 'workflow_contacts' in q, any(n.startswith('op') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_the_rest_works_without_the_training_data_operators(tmp_path, also):
    """Whether the pipeline's file is left behind or not."""
    at = tmp_path / "copy"
    shutil.copytree(REPO, at, ignore=shutil.ignore_patterns(".git", "llm", *also, "__pycache__", "*.json", "*.md"))
    said = subprocess.run([sys.executable, "-c", LISTS], cwd=at, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr
    n, oracles, flagship, llm = said.stdout.split()
    assert (int(n), int(oracles)) == (len(registry.QUERIES), len(registry.SQL)) and flagship == "True" and llm == "False"

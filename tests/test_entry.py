"""The driver's contract: what is registered, and what is left when the training-data operators cannot be imported."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("blocked", ["xxhash", "regex", "public_tokenizers", "starloom.llm", "corpus_pipeline"])
def test_other_queries_survive_a_missing_import(blocked):
    code = f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as e; from starloom.plans import catalogue; assert set(catalogue.QUERIES) <= set(e.queries()) and set(catalogue.SQL) <= set(e.oracle_sql()); assert 'pipeline' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False, capture_output=True).returncode == 0

"""Every registered query against its DuckDB oracle, and the entry point's contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tessera.plans.all import ORACLES, QUERIES, ROWS
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    assert difference(QUERIES[name](spark, SF), ORACLES[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert all(ROWS[name] for name in QUERIES)


def test_nothing_outside_imports_the_llm_subpackage():
    from pathlib import Path

    root = Path(entry.__file__).parent
    files = [f for f in root.rglob("*.py") if not {"llm", ".git"} & set(f.relative_to(root).parts) and f.name not in ("__spark_entry__.py", "corpus_pipeline.py")]
    assert files and not [f for f in files if "tessera" + ".llm" in f.read_text()]

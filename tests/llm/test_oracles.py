"""The corpus queries that SQL can express against their DuckDB oracles."""

from __future__ import annotations

import pytest

from tessera.llm.oracles import ORACLES
from tessera.llm.queries import QUERIES
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert difference(QUERIES[name](spark, SF), ORACLES[name], connect(SF)) == ""

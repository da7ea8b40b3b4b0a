"""The corpus queries against their SQL."""

import pytest
from compare import compare, connect

from rolloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_against_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    problem, rows, _ = compare(spark, connect(sf_dir), sf_dir, QUERIES[name], ORACLES[name])
    assert problem is None and rows > 0

"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from rolloom.workload import MODULES

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem, rows, _ = compare(spark, con, SF_DIR, QUERIES[name], ORACLES[name])
    assert problem is None
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0

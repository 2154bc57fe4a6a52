"""Every registered query against its SQL, on the smallest data."""

from __future__ import annotations

import pytest

from registry import ORACLE, QUERIES
from tests.oracle import difference, oracle, oracle_rows, spark_rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, connection, name):
    found = spark_rows(QUERIES[name](spark, SF_DIR))
    assert difference(found, oracle_rows(connection, ORACLE[name])) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())

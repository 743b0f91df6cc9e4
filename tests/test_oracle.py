import pytest

import __spark_entry__ as contract
from fleetpulse.plans.catalog import QUERIES
from fleetpulse.plans.oracle import ORACLE_SQL
from oracle_check import compare, connect

from conftest import SMALL


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


def test_entry(spark):
    assert contract.entry(spark).count() == 3


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, connection, name):
    assert compare(contract.queries()[name](spark, SMALL), connection.sql(contract.oracle_sql()[name])) is None

import pytest

import __spark_entry__ as registry
from checks.compare import compare, connect
from checks.oracle import SQL
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    assert registry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, registry.queries()[name], registry.oracle_sql()[name]) is None

"""Every query of the catalog at the smallest scale, next to its SQL."""

import os

import pytest

import __spark_entry__ as contract
from shelltrail.catalog.oracle import SQL
from shelltrail.catalog.queries import QUERIES
from oracle_check import DATA, difference, spark_rows, sql_engine, sql_rows

SF_DIR = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no sample tables here")


@pytest.fixture(scope="module")
def engine():
    return sql_engine(SF_DIR)


def test_sql_belongs_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) == set(SQL)


def test_the_check_sees_differences():
    assert difference((["a"], [(1,)]), (["a"], [(2,)])) and difference((["a"], []), (["a"], [(2,)]))
    assert difference((["a"], []), (["b"], [])) and difference((["a"], [(1.5,)]), (["a"], [(1.5,)])) is None


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, engine, name):
    assert difference(spark_rows(QUERIES[name](spark, SF_DIR)), sql_rows(engine, SQL[name])) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0

"""The registered corpus queries over the smallest tables: rows for all, the same rows as their SQL where they have one."""

import pytest

import __spark_entry__ as entry
from reelgrid.llm.queries import QUERIES, SQL
from tests.oracle import connection, rows_of_spark, rows_of_sql


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    assert rows_of_spark(QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())

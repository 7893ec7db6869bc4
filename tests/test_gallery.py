"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, connect
from conftest import SMALL

from __spark_entry__ import entry
from docquarry.gallery import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    ok, message = compare(spark, con, name, QUERIES[name], SQL.get(name), SMALL)
    assert ok, message
    assert "KINDS" not in message, message


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry(spark).columns == ["id"]
    assert entry(spark).count() > 0

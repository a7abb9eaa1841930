"""Queries of the package against their SQL."""

import pytest

from sql_check import connect, rows
from varweave.llm import queries as Q

@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", list(Q.queries()))
def test_query(spark, data, duck, name):
    got = Q.queries()[name](spark, data).toPandas()
    sql = Q.oracle_sql().get(name)
    if sql is not None:
        assert rows(got) == rows(duck.sql(sql).df())
    assert len(got)

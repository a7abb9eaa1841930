"""Every query with SQL gives the rows and columns that DuckDB gives."""

import pytest

import varweave.plans.file_queries as files
import varweave.plans.reference_queries as ref
import varweave.plans.training_queries as tr
from sql_check import connect, rows

CASES = [(m, k) for m in (ref, files, tr) for k in m.queries()]


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("module,name", [pytest.param(m, k, id=k) for m, k in CASES])
def test_query(spark, data, duck, module, name):
    df = module.queries()[name](spark, data)
    got = df.toPandas()
    assert list(got.columns) == df.columns
    sql = module.oracle_sql().get(name)
    if sql is None:
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every registered query with SQL gives the rows of that SQL; the others run."""

import pytest

from tests.oracle import database, rows_of, rows_of_sql
from textmill.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    got = rows_of(df)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    names, want = rows_of_sql(con, sql)
    assert names == sorted(df.columns)
    assert got == want

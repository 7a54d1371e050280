"""Every query with SQL gives the same rows as its SQL; every other one runs and has a stable schema."""

import pytest
from compare import canonical, connect, spark_rows, sql_rows

from lectern.oracle import ORACLE
from lectern.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf_dir, duck, name):
    got, want = spark_rows(QUERIES[name](spark, sf_dir)), sql_rows(duck, ORACLE[name])
    assert got and want
    columns = sorted(want[0])
    assert sorted(got[0]) == columns
    assert canonical(got, columns) == canonical(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0

"""Every query against its SQL on the smallest tables."""

import pytest
from check import difference, duck

import __spark_entry__ as entry

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal(spark, sf_dir, con, name):
    found = entry.queries()[name](spark, sf_dir).toPandas()
    assert len(found)
    assert difference(found, con.execute(ORACLE[name]).df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0

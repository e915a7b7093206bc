"""Every registered query against its SQL, whole tables."""

import oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert query(spark, SF).count() > 0
    else:
        assert oracle.compare(spark, con, query, sql, SF) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0

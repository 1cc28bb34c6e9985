"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

from tallygrid.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
# answered by rows only: no SQL states them, other tests cover them
WITHOUT_SQL = set()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    difference = compare(spark, con, name, SF)
    assert difference in (None, "no rows"), difference


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL
    assert not set(SQL) - set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

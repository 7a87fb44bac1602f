"""Every registered query with SQL gives the SQL's rows."""

import pytest
from helpers import rows

from snaplog.plans import catalogue, store_queries

QUERIES, ORACLES = {**catalogue.QUERIES, **store_queries.QUERIES}, {**catalogue.ORACLES, **store_queries.ORACLES}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, small, sql, name):
    found = QUERIES[name](spark, small)
    assert rows(found) == sql(ORACLES[name], found.columns)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_modules(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())

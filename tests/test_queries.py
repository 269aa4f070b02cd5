"""Every registered query against its SQL, or that it runs where SQL does not express it."""

from __future__ import annotations

import pytest
from oracle import difference

from sheafmill.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_the_sql(spark, sf, name):
    columns, want, extra, missing = difference(spark, sf, QUERIES[name], SQL[name])
    assert columns == want
    assert (extra, missing) == ([], [])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

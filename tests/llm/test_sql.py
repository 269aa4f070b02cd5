"""The opN_ queries against their SQL."""

from __future__ import annotations

import pytest
from oracle import difference

from sheafmill.llm import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_the_sql(spark, sf, name):
    columns, want, extra, missing = difference(spark, sf, QUERIES[name], SQL[name])
    assert columns == want
    assert (extra, missing) == ([], [])

"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

from helixframe import plans
from tests.oracle import oracle_rows, rows_of


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, sf_dir):
    df = plans.QUERIES[name](spark, sf_dir)
    rows = rows_of(df)
    assert rows
    if name in plans.ORACLE_SQL:
        names, expected = oracle_rows(plans.ORACLE_SQL[name], sf_dir)
        assert sorted(df.columns) == names
        assert rows == expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(entry.queries())

"""Registered queries against their SQL on the smallest data."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry

SQL = entry.oracle_sql()
ROWS_ONLY = {"image_files"}


def test_every_query_has_sql_or_is_known_not_to():
    assert set(entry.registry.QUERIES) - set(SQL) == ROWS_ONLY
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, name):
    text, rows, _, _ = differences(spark, connect(sf), name, entry.queries()[name], SQL[name], sf)
    assert text is None, text

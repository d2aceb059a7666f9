"""Every registered query with a DuckDB text gives the same rows as it."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests import oracle


def test_every_text_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, sf, con, name):
    oracle.assert_same(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name])

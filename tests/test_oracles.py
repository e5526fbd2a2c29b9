"""Every registered query with a SQL twin gives the same rows as DuckDB."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from tapeloom.plans import load_all

QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    assert compare(spark, name, QUERIES[name], ORACLES[name], sf, con) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(5).count() > 0

"""Every query of the document engine that SQL can express, against DuckDB; the others give rows."""

from __future__ import annotations

import pytest
from duck import assert_same, connect

from foliomill.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(name, spark, sf_dir, con):
    assert_same(catalogue.QUERIES[name](spark, sf_dir), con, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_gives_rows(name, spark, sf_dir):
    assert catalogue.QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_entry():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())

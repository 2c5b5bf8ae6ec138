"""Every query runs, and gives the rows of its SQL where it has one."""

import pytest

from skeinflow.plans import registry
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, sf, con, name):
    assert_same(registry.QUERIES[name](spark, sf), con, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())

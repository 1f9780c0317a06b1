"""Every registered query against its check SQL on the smallest tables."""

import pytest
from oracle import compare, connect
from trajgraph.catalog import load

REGISTRY = load()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("key", sorted(REGISTRY))
def test_query(spark, sf, con, key):
    item = REGISTRY[key]
    df = item.run(spark, sf)
    if item.sql is None:
        assert df.columns and df.count() >= 0
        return
    ok, note = compare(df, item.sql, con)
    assert ok, note


def test_keys_are_unique_and_flat():
    for key in REGISTRY:
        assert key[0].isalpha() and "pipeline" not in key


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["pair_key", "frequency", "first_token", "second_token"]

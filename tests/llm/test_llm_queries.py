"""The registered queries of the subpackage against their check SQL, where SQL can state them."""

import pytest
from oracle import compare, connect
from trajgraph.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_against_sql(spark, key):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        ok, note = compare(QUERIES[key](spark, sf), SQL[key], connect(sf))
        assert ok, note


def test_one_query_for_each_number():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) == len({k.split("_")[0] for k in QUERIES})

"""The split route of ordered columns equals the plain one, also for a hot key."""

import pytest
from pyspark.sql import functions as F
from trajgraph.plans import ordered as O

SPECS = [
    O.row_number("rn"),
    O.lead("nxt", "v"),
    O.lag("prv", "v"),
    O.running_sum("total", "n"),
    O.running_max("top", "n"),
]


@pytest.fixture(scope="module")
def hot(spark):
    # Key 0 holds a third of the rows; some values are null on purpose.
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(40)) + 1).alias("k"),
        F.pmod(F.xxhash64("id", F.lit(7)), F.lit(100000)).alias("t"),
        "id",
    )
    return df.withColumns(
        {
            "n": F.when(F.col("id") % 11 != 0, (F.col("id") % 17).cast("long")),
            "v": F.when(F.col("id") % 7 != 0, F.col("id")),
        }
    )


@pytest.mark.parametrize("keys", [["k"], []])
def test_split_equals_plain(hot, keys, as_rows):
    plain = O.ordered_columns(hot, keys, ["t", "id"], SPECS, limit=10**9)
    split = O.ordered_columns(hot, keys, ["t", "id"], SPECS, limit=50)
    assert as_rows(plain) == as_rows(split)


def test_descending_order(hot, as_rows):
    order = [F.desc("t"), F.desc("id")]
    plain = O.ordered_columns(hot, ["k"], order, SPECS, hot=False)
    split = O.ordered_columns(hot, ["k"], order, SPECS, hot=True)
    assert as_rows(plain) == as_rows(split)


def test_hot_group_is_found(hot):
    assert O.has_hot_group(hot, ["k"], 900)
    assert not O.has_hot_group(hot, ["k"], 1000)


def test_whole_query_with_tiny_limit(spark, sf, as_rows):
    """A registered query gives the same rows when every group counts as hot."""
    from trajgraph.catalog import load

    reg = load()
    for key in ("P07_merge_pair", "E05_suite_progress", "W04_islands", "P10_action_group_rewrite"):
        want = as_rows(reg[key].run(spark, sf))
        spark.conf.set(O.LIMIT_CONF, "3")
        try:
            got = as_rows(reg[key].run(spark, sf))
        finally:
            spark.conf.unset(O.LIMIT_CONF)
        assert got == want, key

"""Window, sort, limit and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.training import hash_fraction
from ..plans import adapters as A
from ..plans.adapters import with_ctes
from ..plans.ordered import is_hot, lag, ordered_columns, row_number, running_sum
from .registry import query


@query(
    "W01_row_number",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey
         ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS position FROM lineitem""",
)
def _(spark, sf):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    out = ordered_columns(A.table(spark, sf, "lineitem"), ["l_suppkey"], order, [row_number("rn")])
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", (F.col("rn") - 1).alias("position"))


@query(
    "W02_adjacent_pair",
    with_ctes("steps", "SELECT event_id, event_type, next_type FROM steps WHERE next_type IS NOT NULL"),
)
def _(spark, sf):
    return A.steps(spark, sf).filter("next_type IS NOT NULL").select("event_id", "event_type", "next_type")


@query(
    "W03_running_totals",
    with_ctes(
        "ev",
        """SELECT event_id, CAST(sum(k) OVER w AS BIGINT) AS running_k, row_number() OVER w AS n FROM ev
           WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    ),
)
def _(spark, sf):
    ev = A._events(spark, sf).withColumn("k", F.col("k").cast("long"))
    return ordered_columns(ev, [], ["ts", "event_id"], [running_sum("running_k", "k"), row_number("n")]).select(
        "event_id", "running_k", "n"
    )


@query(
    "W04_islands",
    with_ctes(
        "ev",
        """SELECT user_id, island, any_value(event_type) AS event_type, count(*) AS n, min(event_id) AS first_event FROM (
             SELECT *, CAST(sum(CASE WHEN event_type = prev THEN 0 ELSE 1 END) OVER (PARTITION BY user_id
                      ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island
             FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM ev))
           GROUP BY user_id, island""",
    ),
)
def _(spark, sf):
    order = ["ts", "event_id"]
    hot = is_hot(A._events(spark, sf), ["user_id"])
    ev = ordered_columns(A._events(spark, sf), ["user_id"], order, [lag("prev", "event_type")], hot=hot)
    ev = ev.withColumn("fresh", F.when(F.col("event_type") == F.col("prev"), 0).otherwise(1).cast("long"))
    runs = ordered_columns(ev, ["user_id"], order, [running_sum("island", "fresh")], hot=hot)
    return runs.groupBy("user_id", "island").agg(
        F.first("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event")
    )


@query(
    "L01_natural_order",
    with_ctes(
        "episodes",
        """SELECT name, row_number() OVER (ORDER BY string_split(name, '_')[1], coalesce(TRY_CAST(string_split(name, '_')[2] AS BIGINT), 0)) AS rank
           FROM (SELECT DISTINCT instance_name AS name FROM episodes WHERE task_template IS NOT NULL)""",
    ),
)
def _(spark, sf):
    from ..sources.episodes import natural_order

    names = A.episodes(spark, sf).filter("task_template IS NOT NULL").select(F.col("instance_name").alias("name")).distinct()
    return ordered_columns(names, [], natural_order("name", "_"), [row_number("rank")])


@query(
    "L02_top_k",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
)
def _(spark, sf):
    return A.table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query(
    "L02_top_k_per_group",
    """SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (
         PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 8""",
)
def _(spark, sf):
    # The rank filter lets Spark cut each partition to 8 rows per group before the shuffle.
    ranked = A.table(spark, sf, "customer").withColumn(
        "rank", F.expr("row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)")
    )
    return ranked.filter("rank <= 8").select("c_nationkey", "c_custkey", "rank")


@query(
    "L03_argmax",
    """SELECT l_suppkey, arg_max(l_orderkey, (l_shipdate, l_orderkey)) AS newest_order,
              arg_max(l_partkey, (l_extendedprice, l_partkey)) AS dearest_part FROM lineitem GROUP BY l_suppkey""",
)
def _(spark, sf):
    return A.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.max_by("l_orderkey", F.struct("l_shipdate", "l_orderkey")).alias("newest_order"),
        F.max_by("l_partkey", F.struct("l_extendedprice", "l_partkey")).alias("dearest_part"),
    )


@query(
    "L04_sampled_order",
    """SELECT c_custkey FROM customer ORDER BY CAST('0x' || substr(md5(c_custkey || '_7'), 1, 8) AS BIGINT), c_custkey LIMIT 75""",
)
def _(spark, sf):
    c = A.table(spark, sf, "customer").select("c_custkey")
    return c.orderBy(hash_fraction(F.col("c_custkey"), 7), "c_custkey").limit(75)


@query(
    "O01_union",
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""",
)
def _(spark, sf):
    c = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query(
    "O02_intersect",
    "SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 48",
)
def _(spark, sf):
    li = A.table(spark, sf, "lineitem")
    return li.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id")).intersect(
        li.filter("l_quantity > 48").select(F.col("l_partkey").alias("id"))
    )


@query(
    "O03_except",
    "SELECT l_orderkey, l_partkey FROM lineitem EXCEPT ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'N'",
)
def _(spark, sf):
    li = A.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_partkey").exceptAll(li.filter("l_returnflag = 'N'").select("l_orderkey", "l_partkey"))


@query(
    "O04_ordered_distinct",
    with_ctes(
        "ev",
        "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_event FROM ev GROUP BY ALL",
    ),
)
def _(spark, sf):
    return A._events(spark, sf).groupBy("user_id", "event_type").agg(
        F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event")
    )


@query(
    "E12_common_set",
    with_ctes("steps", "SELECT DISTINCT page, task FROM steps"),
)
def _(spark, sf):
    # Distinct names over set-valued columns: sets stay rows, so no page gathers them.
    s = A.steps(spark, sf)
    sets = s.select("page", F.array("task").alias("tasks"))
    return sets.select("page", F.explode("tasks").alias("task")).distinct()

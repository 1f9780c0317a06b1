"""Views of the generic test tables in the shapes the operators take.

Each adapter has the same rule written twice: as a DataFrame, and as a SQL
common table expression (``CTE``) that the oracle queries build on.
"""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import kept
from .ordered import lead, ordered_columns, row_number


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir):
    return shape_events(table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    return shape_events(
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )


def shape_events(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per recorded step: a task is a user, a branch is one of its days."""
    ev = _events(spark, sf_dir).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("task"),
        F.date_format("ts", "yyyy-MM-dd").alias("branch"),
        "event_id",
        "ts",
        "event_type",
        "value",
        "k",
        F.concat_ws("_", "event_type", F.col("k").cast("string")).alias("page"),
        F.concat_ws(
            "_tap", "event_type", F.floor(F.col("k") / 25).cast("string")
        ).alias("control"),
    )
    out = ordered_columns(
        ev,
        ["task", "branch"],
        ["ts", "event_id"],
        [row_number("rn"), lead("next_page", "page"), lead("next_type", "event_type")],
        hot=False,  # one user's day is a small group by nature
    )
    return out.withColumn("step", F.col("rn") - 1).drop("rn")


# Frames of the running query that are stored once and shared by all of its parts.
_FRAMES: ContextVar[dict | None] = ContextVar("frames", default=None)


@contextmanager
def one_query():
    """Inside, the views marked :func:`per_query` are stored on first use and read from there."""
    token = _FRAMES.set({})
    try:
        yield
    finally:
        _FRAMES.reset(token)


def per_query(view):
    """A view that is built once for each query."""

    @wraps(view)
    def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = _FRAMES.get()
        if frames is None:
            return view(spark, sf_dir)
        if view.__name__ not in frames:
            frames[view.__name__] = kept(view(spark, sf_dir), view.__name__)
        return frames[view.__name__]

    return shared


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-level transitions: task, branch, step, src, elem, tgt."""
    return (
        steps(spark, sf_dir)
        .filter(F.col("next_page").isNotNull())
        .select(
            "task",
            "branch",
            "step",
            "ts",
            "value",
            "k",
            F.col("page").alias("src"),
            F.concat_ws(">", "page", "next_page").alias("elem"),
            F.col("next_page").alias("tgt"),
        )
    )


@per_query
def shared_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`edges` for queries that derive several graph tables from them."""
    return edges(spark, sf_dir)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mining chains: chain_id, pos and a coarse (src, elem, tgt) token."""
    return (
        steps(spark, sf_dir)
        .filter(F.col("next_type").isNotNull())
        .select(
            F.concat_ws("/", "task", "branch").alias("chain_id"),
            F.col("step").alias("pos"),
            F.col("event_type").alias("src"),
            F.col("control").alias("elem"),
            F.col("next_type").alias("tgt"),
        )
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode records: templates by props.k, error events are failed runs."""
    ev = _events(spark, sf_dir)
    failed = F.col("event_type") == "error"
    template = F.when(F.col("k") == 99, F.lit(None)).otherwise(
        F.concat(F.lit("Task"), F.floor(F.col("k") / 4).cast("string"))
    )
    return ev.select(
        F.col("event_id").alias("instance_id"),
        template.alias("task_template"),
        F.concat_ws("_", template, F.col("user_id").cast("string")).alias("instance_name"),
        F.when(~failed, (F.col("value") >= 40).cast("double")).alias("is_successful"),
        F.col("value").cast("decimal(18,2)").alias("run_time"),
        F.when(~failed, F.col("k").cast("double")).alias("episode_length"),
        F.when(failed, F.lit("RuntimeError")).alias("exception_info"),
        F.col("user_id").alias("seed"),
        F.col("ts").alias("finish_dtime"),
    )


def task_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side table of the episode reports, one row per template that occurs."""
    names = (
        episodes(spark, sf_dir)
        .filter(F.col("task_template").isNotNull())
        .select("task_template", F.substring("task_template", 5, 9).cast("int").alias("n"))
        .distinct()
    )
    return names.select(
        "task_template",
        F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), F.col("n") % 3 + 1)
        .alias("difficulty"),
        (F.col("n") + 5).alias("optimal_steps"),
        F.when(F.col("n") % 5 == 0, F.array(F.lit("")))
        .when(F.col("n") % 2 == 0, F.array(F.lit("data_entry"), F.lit("search")))
        .otherwise(F.array(F.lit("search"))).alias("tags"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("ns"), F.col("label").cast("string")).alias("namespace"),
        F.col("embedding").alias("values"),
    )


@per_query
def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search trees: one per region, then nations, customers and their orders.

    Order nodes carry the reward; visits and values are totals over the orders
    below a node.
    """
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    per_customer = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("visits"), F.sum(price).alias("total")
    )
    n = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    c = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    o = F.concat(F.lit("O"), F.col("o_orderkey").cast("string"))
    home = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "r_name", "r_regionkey", "n_nationkey", "n_name"
    )
    root = F.concat(F.lit("R"), F.col("r_regionkey").cast("string"))
    cust = customer.join(home, F.col("c_nationkey") == F.col("n_nationkey")).join(
        per_customer, "c_custkey", "left"
    )

    def node(df, node_id, parent_id, depth, actions, name, visits, total, r):
        return df.select(
            F.col("r_name").alias("tree_id"), node_id.alias("node_id"), parent_id.alias("parent_id"),
            F.lit(depth).alias("depth"), actions.alias("action_list"), name.alias("page_name"),
            visits.cast("long").alias("visits"), (total.cast("double") / 100000).alias("value"), r.alias("r"),
        )

    zero = F.lit(0.0)
    visits = F.coalesce("visits", F.lit(0))
    total = F.coalesce("total", F.lit(0).cast("decimal(18,2)"))
    sums = [F.sum(visits).alias("visits"), F.sum(total).alias("total")]
    reward = (
        F.when(F.col("o_orderstatus") == "F", 1.0)
        .when(F.col("o_orderstatus") == "O", F.least(F.floor(F.col("o_totalprice") / 5000) / 100, F.lit(0.99)))
        .otherwise(0.0)
    )
    leaves = orders.join(cust.drop("visits", "total"), F.col("o_custkey") == F.col("c_custkey"))
    parts = [
        node(
            cust.groupBy("r_name", "r_regionkey").agg(*sums), root, F.lit(None).cast("string"), 0,
            F.array().cast("array<string>"), F.col("r_name"), F.col("visits"), F.col("total"), zero,
        ),
        node(
            cust.groupBy("r_name", "r_regionkey", "n_nationkey", "n_name").agg(*sums), n, root, 1,
            F.array(n), F.col("n_name"), F.col("visits"), F.col("total"), zero,
        ),
        node(cust, c, n, 2, F.array(n, c), F.col("c_mktsegment"), visits, total, zero),
        node(leaves, o, c, 3, F.array(n, c, o), F.col("o_orderpriority"), F.lit(1), price, reward),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@per_query
def golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold paths per tree: the way to its dearest F order and to its dearest O order."""
    leaves = tree(spark, sf_dir).filter(F.col("depth") == 3).select("tree_id", "node_id", "action_list", "value", "r")
    kind = F.when(F.col("r") == 1.0, "F").when(F.col("r") > 0, "O")
    best = leaves.withColumn("kind", kind).filter(F.col("kind").isNotNull()).groupBy("tree_id", "kind").agg(
        F.max_by("action_list", F.struct("value", "node_id")).alias("gold")
    )
    return best.groupBy("tree_id").agg(
        F.array_sort(F.collect_list(F.struct("kind", "gold")))["gold"].alias("golds")
    )


# The same rules in SQL. Keys are CTE names, values their bodies.
CTE = {
    "ev": """
        SELECT event_id, user_id, ts, event_type, value,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
        FROM events""",
    "steps": """
        SELECT 'u' || user_id AS task, strftime(ts, '%Y-%m-%d') AS branch, event_id, ts,
               event_type, value, k, event_type || '_' || k AS page,
               event_type || '_tap' || (k // 25) AS control,
               row_number() OVER w - 1 AS step,
               lead(event_type || '_' || k) OVER w AS next_page,
               lead(event_type) OVER w AS next_type
        FROM ev
        WINDOW w AS (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id)""",
    "edges": """
        SELECT task, branch, step, ts, value, k, page AS src,
               page || '>' || next_page AS elem, next_page AS tgt
        FROM steps WHERE next_page IS NOT NULL""",
    "tokens": """
        SELECT task || '/' || branch AS chain_id, step AS pos, event_type AS src,
               control AS elem, next_type AS tgt
        FROM steps WHERE next_type IS NOT NULL""",
    "episodes": """
        SELECT event_id AS instance_id,
               CASE WHEN k = 99 THEN NULL ELSE 'Task' || (k // 4) END AS task_template,
               CASE WHEN k = 99 THEN '' ELSE 'Task' || (k // 4) || '_' END || user_id
                 AS instance_name,
               CASE WHEN event_type <> 'error' THEN CAST(value >= 40 AS DOUBLE) END AS is_successful,
               CAST(value AS DECIMAL(18,2)) AS run_time,
               CASE WHEN event_type <> 'error' THEN CAST(k AS DOUBLE) END AS episode_length,
               CASE WHEN event_type = 'error' THEN 'RuntimeError' END AS exception_info,
               user_id AS seed, ts AS finish_dtime
        FROM ev""",
    "task_metadata": """
        SELECT task_template, ['easy', 'medium', 'hard'][n % 3 + 1] AS difficulty,
               n + 5 AS optimal_steps,
               CASE WHEN n % 5 = 0 THEN [''] WHEN n % 2 = 0 THEN ['data_entry', 'search']
                    ELSE ['search'] END AS tags
        FROM (SELECT DISTINCT task_template, CAST(substr(task_template, 5) AS INTEGER) AS n
              FROM episodes WHERE task_template IS NOT NULL)""",
    "tree": """
        SELECT r_name AS tree_id, 'R' || r_regionkey AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 0 AS depth,
               CAST([] AS VARCHAR[]) AS action_list, r_name AS page_name, sum(visits) AS visits,
               CAST(sum(total) AS DOUBLE) / 100000 AS value, 0.0::DOUBLE AS r
        FROM cust GROUP BY r_name, r_regionkey
        UNION ALL
        SELECT r_name, 'N' || n_nationkey, 'R' || r_regionkey, 1, ['N' || n_nationkey], n_name,
               sum(visits), CAST(sum(total) AS DOUBLE) / 100000, 0.0
        FROM cust GROUP BY r_name, r_regionkey, n_nationkey, n_name
        UNION ALL
        SELECT r_name, 'C' || c_custkey, 'N' || n_nationkey, 2, ['N' || n_nationkey, 'C' || c_custkey], c_mktsegment,
               visits, CAST(total AS DOUBLE) / 100000, 0.0
        FROM cust
        UNION ALL
        SELECT r_name, 'O' || o_orderkey, 'C' || c_custkey, 3,
               ['N' || n_nationkey, 'C' || c_custkey, 'O' || o_orderkey], o_orderpriority, 1,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) / 100000,
               CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN least(floor(o_totalprice / 5000) / 100, 0.99) ELSE 0.0 END
        FROM orders JOIN cust ON o_custkey = c_custkey""",
    "cust": """
        SELECT c_custkey, c_mktsegment, n_nationkey, n_name, r_regionkey, r_name,
               coalesce(visits, 0) AS visits, coalesce(total, 0) AS total
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN (SELECT o_custkey, count(*) AS visits, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total
                   FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
    "golds": """
        SELECT tree_id, list(gold ORDER BY kind) AS golds FROM (
          SELECT tree_id, CASE WHEN r = 1.0 THEN 'F' WHEN r > 0 THEN 'O' END AS kind,
                 arg_max(action_list, (value, node_id)) AS gold
          FROM tree WHERE depth = 3 GROUP BY 1, 2)
        WHERE kind IS NOT NULL GROUP BY tree_id""",
    "vectors": """
        SELECT vec_id AS id, 'ns' || label AS namespace, embedding AS "values" FROM embeddings""",
}

_NEEDS = {
    "steps": ["ev"],
    "edges": ["ev", "steps"],
    "tokens": ["ev", "steps"],
    "episodes": ["ev"],
    "task_metadata": ["ev", "episodes"],
    "tree": ["cust"],
    "golds": ["cust", "tree"],
}


def with_ctes(names: str, body: str, recursive: bool = False, extra: str = "") -> str:
    """``WITH`` clause holding the named adapters (and what they need), then ``body``."""
    wanted: list[str] = []
    for name in names.split():
        for dep in [*_NEEDS.get(name, []), name]:
            if dep not in wanted:
                wanted.append(dep)
    parts = [f"{n} AS ({CTE[n]})" for n in wanted]
    if extra:
        parts.append(extra)
    word = "WITH RECURSIVE " if recursive else "WITH "
    return word + ",\n".join(parts) + "\n" + body

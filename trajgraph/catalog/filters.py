"""Filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as X
from ..plans import adapters as A
from ..plans.adapters import with_ctes
from ..plans.ordered import ordered_columns, row_number
from .registry import query


def elements(spark, sf):
    """UI elements: order lines as screen elements with boxes and flags."""
    q, n, p = F.col("l_quantity").cast("int"), F.col("l_linenumber"), F.pmod("l_partkey", F.lit(7)).cast("int")
    box = F.struct(
        (q * 30 - 100).alias("x_min"), (q * 30 - 100 + p * 20).alias("x_max"), (n * 400).alias("y_min"), (n * 400 + 50).alias("y_max")
    )
    return A.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("screen_id"), F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey", "l_extendedprice",
        F.when(p != 6, box).alias("bbox_pixels"), (F.col("l_returnflag") != "A").alias("is_visible"),
        F.when(F.col("l_returnflag") == "N", "android.widget.Button").when(F.col("l_returnflag") == "R", "android.widget.TextView").alias("class_name"),
        F.when(p == 1, "ok").when(p == 2, "").alias("text"), F.when(p == 3, "menu").alias("content_description"),
        F.lit(None).cast("string").alias("hint_text"), F.when(p == 4, "app:id/x").alias("resource_name"),
        F.when(p == 0, True).alias("is_clickable"), F.when(p == 1, False).alias("is_scrollable"),
        F.when(p == 2, True).alias("is_long_clickable"), F.lit(None).cast("boolean").alias("is_editable"),
    )


P = "(l_partkey % 7)"


@query(
    "F03_valid_element_filter",
    f"""SELECT l_orderkey AS screen_id, l_linenumber AS line, l_partkey FROM lineitem
        WHERE l_returnflag <> 'A' AND ({P} = 6 OR NOT ({P} * 20 <= 0 OR l_quantity * 30 - 100 >= 1080
          OR l_quantity * 30 - 100 + {P} * 20 <= 0 OR l_linenumber * 400 >= 2400))""",
)
def _(spark, sf):
    ok = X.valid_element(F.lit(1080), F.lit(2400))
    return elements(spark, sf).filter(ok).select("screen_id", "line", "l_partkey")


@query(
    "F04_describable_element_filter",
    f"""SELECT screen_id, idx, CASE WHEN idx < 26 THEN chr(65 + CAST(idx AS INT)) END AS letter, l_partkey FROM (
          SELECT l_orderkey AS screen_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey
                   ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx
          FROM lineitem WHERE l_returnflag IN ('N', 'R') AND {P} IN (1, 3, 4))""",
)
def _(spark, sf):
    kept = elements(spark, sf).filter(X.describable_element())
    out = ordered_columns(kept, ["screen_id"], ["line", "l_partkey", "l_suppkey", "l_extendedprice"], [row_number("rn")])
    idx = F.col("rn") - 1
    return out.select("screen_id", idx.alias("idx"), X.letter_index(idx).alias("letter"), "l_partkey")


@query(
    "F05_interactable_filter",
    f"SELECT l_orderkey AS screen_id, l_linenumber AS line, l_partkey FROM lineitem WHERE {P} IN (0, 2)",
)
def _(spark, sf):
    return elements(spark, sf).filter(X.interactable_element()).select("screen_id", "line", "l_partkey")


@query(
    "F02_actionable_step_filter",
    with_ctes("ev", "SELECT event_id FROM ev WHERE event_type <> 'error' AND k % 3 <> 0"),
)
def _(spark, sf):
    steps = A._events(spark, sf).select(
        "event_id", F.when(F.col("event_type") != "error", F.col("k")).alias("element_index"),
        F.when(F.col("k") % 3 != 0, F.struct("k", "event_type")).alias("target_element"),
    )
    return X.actionable_steps(steps).select("event_id")


@query(
    "F06_exclusion_filter",
    """SELECT doc_id FROM documents WHERE NOT (lower(lang) = 'en' AND n_chars > 800 AND contains(lower(text), 'the'))""",
)
def _(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "text")
    conditions = [("lang", "=", "EN"), ("n_chars", ">", 800), ("text", "contains", "The"), ("folder", "=", "unknown field")]
    return X.exclusion_filter(d, conditions, text=("lang", "text")).select("doc_id")


@query("F06_unknown_fields_only", "SELECT doc_id FROM documents WHERE FALSE")
def _(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", "lang")
    return X.exclusion_filter(d, [("folder", "=", "x")]).select("doc_id")


@query(
    "F06_event_exclusion",
    """WITH e AS (SELECT o_orderkey, o_orderdate AS s, o_orderdate + INTERVAL 1 HOUR * floor(o_totalprice / 10000) AS t,
                         o_orderpriority AS title FROM orders)
       SELECT o_orderkey FROM e WHERE NOT (CAST(s AS DATE) <= DATE '1998-03-04' AND CAST(t AS DATE) >= DATE '1998-03-04'
         AND contains(lower(title), 'high'))""",
)
def _(spark, sf):
    start = F.col("o_orderdate").cast("timestamp")
    e = A.table(spark, sf, "orders").select(
        "o_orderkey", start.alias("start_ts"),
        (start + F.make_dt_interval(hours=F.floor(F.col("o_totalprice") / 10000).cast("int"))).alias("end_ts"),
        F.col("o_orderpriority").alias("title"),
    )
    return X.exclude_events(e, [("start_date", "=", "1998-03-04"), ("title", "contains", "HIGH")]).select("o_orderkey")


@query(
    "F14_task_subset",
    """SELECT o_orderkey FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders GROUP BY 1 HAVING min(o_orderkey) < 3)""",
)
def _(spark, sf):
    o = A.table(spark, sf, "orders")
    wanted = o.groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("m")).filter("m < 3")
    return X.subset(o, wanted, "o_orderpriority").select("o_orderkey")


# Names in other letters and with signs around them are as near as can be to a known one; numbers are near to none.
@query(
    "F14_unknown_names",
    """WITH known AS (SELECT DISTINCT p_name AS k FROM part),
       wanted AS (SELECT DISTINCT '*' || upper(p_name) || '!!' AS name FROM part UNION SELECT '#' || p_partkey FROM part),
       plain AS (SELECT name, trim(lower(regexp_replace(name, '[^A-Za-z0-9]', ' ', 'g'))) AS p FROM wanted)
       SELECT name, min(k) AS suggestion FROM plain LEFT JOIN known ON trim(lower(regexp_replace(k, '[^A-Za-z0-9]', ' ', 'g'))) = p GROUP BY name""",
)
def _(spark, sf):
    p = A.table(spark, sf, "part")
    known = p.select(F.col("p_name").alias("name")).distinct()
    wanted = p.select(F.concat(F.lit("*"), F.upper("p_name"), F.lit("!!")).alias("name"))
    return X.unknown_names(wanted.unionByName(p.select(F.concat(F.lit("#"), F.col("p_partkey").cast("string")).alias("name"))), known)


@query(
    "F15_noise_title_filter",
    """SELECT p_partkey FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_brand = 'Brand#1' AND p_size < 10)""",
)
def _(spark, sf):
    p = A.table(spark, sf, "part")
    targets = p.filter("p_brand = 'Brand#1' AND p_size < 10")
    return X.without_titles(p, targets, "p_name").select("p_partkey")


@query("S04_retry_list_filter", with_ctes("steps", "SELECT event_id FROM steps WHERE task IN (SELECT task FROM steps GROUP BY 1 HAVING count(*) > 70)"))
def _(spark, sf):
    s = A.steps(spark, sf)
    retry = s.groupBy("task").count().filter("count > 70")
    return X.subset(s, retry, "task").select("event_id")

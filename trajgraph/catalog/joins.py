"""Queries for the joins with a shape of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.udfs import fuzzy_match
from ..operators import joins as J
from ..plans import adapters as A
from ..plans.adapters import with_ctes
from .registry import query

# Playlists are orders, media are parts, the relation is the order's lines.
PLAYLIST = "o_orderpriority || '/' || o_orderkey"


@query(
    "J06_playlist_join",
    f"""SELECT {PLAYLIST} AS playlist_name, p_name || '_' || p_partkey AS media_file_name, l_linenumber AS order_in_playlist
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey""",
)
def _(spark, sf):
    pl = A.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id_playlist"),
        F.concat_ws("/", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("name"),
    )
    rel = A.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id_playlist"), F.col("l_partkey").alias("id_media"), F.col("l_linenumber").alias("position")
    )
    media = A.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id_media"), F.concat_ws("_", "p_name", F.col("p_partkey").cast("string")).alias("filename")
    )
    return J.playlist_join(pl, rel, media)


@query(
    "J07_playlist_rownum_join",
    f"""SELECT {PLAYLIST} AS playlist_name, CAST(l_partkey AS VARCHAR) AS media_file_name, l_quantity AS duration_ms,
              row_number() OVER (PARTITION BY {PLAYLIST} ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1
                AS order_in_playlist
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
)
def _(spark, sf):
    pl = A.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("playlist_id"),
        F.concat_ws("/", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("playlist_name"),
    )
    songs = A.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("playlist_creator_id"), F.col("l_partkey").cast("string").alias("title"),
        F.col("l_quantity").alias("duration"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("song_key"),
    )
    return J.playlist_rownum_join(pl, songs)


@query(
    "J09_package_app_resolve",
    """SELECT o_orderkey, CASE WHEN n_nationkey IS NOT NULL AND o_orderstatus <> 'P' THEN n_name
                ELSE replace('app ' || o_orderpriority, ' ', '-') END AS app_key
       FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def _(spark, sf):
    rows = A.table(spark, sf, "orders").join(
        A.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey"
    ).select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("c_nationkey")).alias("package"),
        F.col("o_orderpriority").alias("task"),
    )
    packages = A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("package"), F.col("n_name").alias("app"))
    tasks = A.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("task")).distinct().withColumn(
        "task_app", F.concat(F.lit("app "), "task")
    )
    return J.resolve_app(rows, packages, tasks).select("o_orderkey", "app_key")


@query(
    "J10_folder_name_lookup",
    "SELECT c_custkey AS note_id, n_name AS folder FROM customer JOIN nation ON n_nationkey = c_nationkey",
)
def _(spark, sf):
    notes = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("note_id"), F.col("c_nationkey").alias("parent_id"))
    folders = A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("parent_id"), F.col("n_name").alias("folder"))
    return notes.join(folders, "parent_id").select("note_id", "folder")


@query(
    "J13_nearest_coords",
    """SELECT c_custkey AS point_id, s_suppkey AS place_id FROM customer, supplier
       WHERE abs(c_acctbal / 100 - s_acctbal / 100) < 0.5 AND abs(c_nationkey::DOUBLE - s_nationkey) < 0.5""",
)
def _(spark, sf):
    pts = A.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("point_id"), (F.col("c_acctbal") / 100).alias("lat"), F.col("c_nationkey").cast("double").alias("lon")
    )
    places = A.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("place_id"), (F.col("s_acctbal") / 100).alias("p_lat"), F.col("s_nationkey").cast("double").alias("p_lon")
    )
    return J.nearest_coords(pts, places, 0.5).select("point_id", "place_id")


@query(
    "E32_favourite_contains",
    """SELECT c_custkey AS episode_id, contains(c_name, '77') OR coalesce(n.hit, FALSE) AS ok FROM customer
       LEFT JOIN (SELECT c_custkey AS k, TRUE AS hit FROM customer, supplier
                  WHERE abs(c_acctbal / 100 - s_acctbal / 100) < 0.5 AND abs(c_nationkey::DOUBLE - s_nationkey) < 0.5 GROUP BY 1) n
       ON n.k = c_custkey""",
)
def _(spark, sf):
    c = A.table(spark, sf, "customer")
    pts = c.select(F.col("c_custkey").alias("point_id"), (F.col("c_acctbal") / 100).alias("lat"), F.col("c_nationkey").cast("double").alias("lon"))
    places = A.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("place_id"), (F.col("s_acctbal") / 100).alias("p_lat"), F.col("s_nationkey").cast("double").alias("p_lon")
    )
    near = J.nearest_coords(pts, places, 0.5).select(F.col("point_id").alias("episode_id"), F.lit(True).alias("hit")).distinct()
    return c.select(F.col("c_custkey").alias("episode_id"), "c_name").join(near, "episode_id", "left").select(
        "episode_id", (F.col("c_name").contains("77") | F.coalesce("hit", F.lit(False))).alias("ok")
    )


@query(
    "J14_interval_overlap",
    """WITH pts AS (SELECT DISTINCT CAST(epoch(l_shipdate) AS BIGINT) AS at_s FROM lineitem),
       ev AS (SELECT CAST(epoch(o_orderdate) AS BIGINT) AS s, CAST(epoch(o_orderdate) AS BIGINT)
                + CAST(floor(o_totalprice / 100000) AS BIGINT) * 86400 AS e FROM orders)
       SELECT at_s, count(*) AS n FROM pts JOIN ev ON s <= at_s AND e >= at_s GROUP BY at_s""",
)
def _(spark, sf):
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    ev = A.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"), start.alias("start_s"),
        (start + F.floor(F.col("o_totalprice") / 100000) * 86400).alias("end_s"),
    )
    at = F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("at_s")
    pts = A.table(spark, sf, "lineitem").select(at).distinct().withColumn("point_id", F.col("at_s"))
    return J.interval_overlap(ev, pts).groupBy("at_s").agg(F.count(F.lit(1)).alias("n"))


@query(
    "J17_vertical_adjacent",
    """WITH el AS (SELECT l_orderkey AS screen_id, l_linenumber * 100 + l_partkey % 100 AS idx, l_returnflag AS text,
                          l_quantity * 10 AS y_min, l_quantity * 10 + 20 + l_linenumber * 10 AS y_max FROM lineitem)
       SELECT f.screen_id, f.idx AS field_id, min(e.idx) AS label_idx FROM el f JOIN el e
         ON e.screen_id = f.screen_id AND e.text = 'R' AND e.y_min BETWEEN f.y_max AND f.y_max + (f.y_max - f.y_min)
       WHERE f.text <> 'R' GROUP BY f.screen_id, f.idx""",
)
def _(spark, sf):
    el = A.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("screen_id"), (F.col("l_linenumber") * 100 + F.pmod("l_partkey", F.lit(100))).alias("idx"),
        F.col("l_returnflag").alias("text"), (F.col("l_quantity") * 10).alias("y_min"),
        (F.col("l_quantity") * 10 + 20 + F.col("l_linenumber") * 10).alias("y_max"),
    )
    fields = el.filter("text <> 'R'").select("screen_id", F.col("idx").alias("field_id"), F.lit("R").alias("label"), "y_min", "y_max")
    return J.label_below(fields, el.select("screen_id", "idx", "text", F.col("y_min").alias("e_min")))


@query(
    "J20_referred_element",
    with_ctes(
        "ev",
        """SELECT a.event_id, e.idx FROM ev a JOIN (
             SELECT user_id, chr(65 + k % 26) AS letter, min(event_id) AS idx FROM ev GROUP BY ALL) e
           ON e.user_id = a.user_id AND e.letter = chr(65 + (a.k + 1) % 26)
           WHERE a.event_type IN ('click', 'view')""",
    ),
)
def _(spark, sf):
    ev = A._events(spark, sf)
    letter = lambda k: F.char(F.pmod(k, F.lit(26)) + 65)
    el = ev.groupBy(F.col("user_id").alias("screen_id"), letter(F.col("k")).alias("letter")).agg(F.min("event_id").alias("idx"))
    kind = F.when(F.col("event_type") == "click", "CLICK").when(F.col("event_type") == "view", "SWIPE").otherwise("WAIT")
    acts = ev.select("event_id", F.col("user_id").alias("screen_id"), kind.alias("action"), letter(F.col("k") + 1).alias("letter"))
    return J.referred_element(acts, el).select("event_id", "idx")


@query("K06_fuzzy_join")
def _(spark, sf):
    text = F.concat_ws(" ", "p_name", "p_type")
    p = A.table(spark, sf, "part")
    left = p.select(F.col("p_partkey").alias("left_id"), text.alias("left_text"))
    right = p.groupBy(F.upper(text).alias("right_text")).agg(F.min("p_partkey").alias("right_id"))
    return J.fuzzy_join(left, right)


@query("U01_fuzzy_match", "SELECT p_partkey FROM part WHERE lower(p_type) = 'promo'")
def _(spark, sf):
    p = A.table(spark, sf, "part")
    return p.filter(fuzzy_match(F.col("p_type"), F.lit("promo"))).select("p_partkey")

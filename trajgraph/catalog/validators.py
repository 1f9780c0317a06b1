"""Grading queries: customers are episodes, their orders and lines are app rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.parsing import sms_fields
from ..operators import validators as V
from ..plans import adapters as A
from ..plans.ordered import ordered_columns, row_number
from .registry import query

EP = V.EP
COLS = ["id", "price", "priority"]

# Before: every order. After: finished orders are gone unless dear, urgent cheap
# ones got lost, and pending dear ones had their priority changed.
ROWS = """
before_ AS (
  SELECT o_custkey AS episode_id, o_orderkey AS id, o_totalprice AS price, o_orderpriority AS priority,
         o_orderstatus AS status FROM orders),
after_ AS (
  SELECT episode_id, id, price, CASE WHEN status = 'P' AND price > 490000 THEN 'changed' ELSE priority END AS priority, status
  FROM before_ WHERE NOT (status = 'F' AND price <= 480000) AND NOT (status <> 'F' AND priority = '1-URGENT' AND price < 20000)),
sides AS (
  SELECT episode_id, id, price, priority, sum(b) AS b, sum(a) AS a FROM (
    SELECT episode_id, id, price, priority, 1 AS b, 0 AS a FROM before_
    UNION ALL SELECT episode_id, id, price, priority, 0, 1 FROM after_) GROUP BY ALL)"""


def orders(spark, sf):
    return A.table(spark, sf, "orders").select(
        F.col("o_custkey").alias(EP), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), "o_orderdate",
    )


def before_after(spark, sf):
    b = orders(spark, sf)
    status, price = F.col("status"), F.col("price")
    a = b.filter(
        ~((status == "F") & (price <= 480000)) & ~((status != "F") & (F.col("priority") == "1-URGENT") & (price < 20000))
    ).withColumn("priority", F.when((status == "P") & (price > 490000), "changed").otherwise(F.col("priority")))
    return b, a


@query(
    "E20_removal_integrity",
    "WITH " + ROWS.strip() + """,
targets AS (
  SELECT episode_id, id FROM before_ WHERE status = 'F'
  UNION SELECT c_custkey, -1 FROM customer WHERE c_acctbal < 0)
SELECT coalesce(s.episode_id, u.episode_id) AS episode_id, coalesce(n_left, 0) AS n_left, coalesce(n_missing, 0) AS n_missing,
       coalesce(n_extra, 0) AS n_extra, coalesce(n_unknown, 0) AS n_unknown,
       CASE WHEN coalesce(n_unknown, 0) = 0 THEN n_left + n_missing + n_extra = 0 END AS ok
FROM (SELECT s.episode_id, count(*) FILTER (t.id IS NOT NULL AND b > 0 AND a > 0) AS n_left,
             count(*) FILTER (t.id IS NULL AND b > 0 AND a = 0) AS n_missing, count(*) FILTER (b = 0 AND a > 0) AS n_extra
      FROM sides s LEFT JOIN targets t ON t.episode_id = s.episode_id AND t.id = s.id GROUP BY s.episode_id) s
FULL JOIN (SELECT episode_id, count(*) AS n_unknown FROM targets WHERE id = -1 GROUP BY 1) u ON u.episode_id = s.episode_id""",
)
def _(spark, sf):
    b, a = before_after(spark, sf)
    lost = A.table(spark, sf, "customer").filter("c_acctbal < 0").select(
        F.col("c_custkey").alias(EP), F.lit(-1).cast("long").alias("id")
    )
    targets = b.filter("status = 'F'").select(EP, "id").unionByName(lost)
    return V.removal_integrity(b, a, targets, "id", COLS)


ADDED = """
old AS (SELECT o_custkey AS episode_id, o_orderkey AS id, o_totalprice AS price, o_orderpriority AS priority,
               CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus <> 'P'),
refs AS (SELECT o_custkey AS episode_id, o_orderkey AS ref_id, o_totalprice AS price, lower(o_orderpriority) AS priority,
                CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'P'),
new AS (SELECT * FROM old WHERE NOT (priority = '5-LOW' AND price < 9000)
        UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority, CAST(o_orderdate AS DATE) FROM orders
        WHERE o_orderstatus = 'P' AND o_totalprice < 450000),
hits AS (SELECT DISTINCT r.episode_id, r.ref_id FROM refs r JOIN new n
         ON n.episode_id = r.episode_id AND n.price = r.price AND n.day = r.day AND lower(n.priority) = lower(r.priority))"""


def added(spark, sf):
    o = orders(spark, sf).withColumn("day", F.to_date("o_orderdate"))
    cols = [EP, "id", "price", "priority", "day"]
    old = o.filter("status <> 'P'").select(*cols)
    refs = o.filter("status = 'P'").select(EP, F.col("id").alias("ref_id"), "price", F.lower("priority").alias("priority"), "day")
    new = old.filter("NOT (priority = '5-LOW' AND price < 9000)").unionByName(
        o.filter("status = 'P' AND price < 450000").select(*cols)
    )
    return old, new, refs


@query("J12_reference_match", "WITH " + ADDED.strip() + " SELECT episode_id, ref_id FROM hits")
def _(spark, sf):
    _, new, refs = added(spark, sf)
    return V.reference_match(refs, new, ["price", "day"], ["priority"])


@query(
    "E21_addition_integrity",
    "WITH " + ADDED.strip() + """,
cnt AS (SELECT episode_id, count(*) FILTER (side = 'b') AS nb, count(*) FILTER (side = 'a') AS na FROM (
          SELECT episode_id, 'b' AS side FROM old UNION ALL SELECT episode_id, 'a' FROM new) GROUP BY 1),
chg AS (SELECT episode_id, count(*) AS n FROM (SELECT DISTINCT * FROM old EXCEPT SELECT * FROM new) GROUP BY 1),
rf AS (SELECT r.episode_id, count(*) AS n, count(*) FILTER (h.ref_id IS NULL) AS miss FROM refs r
       LEFT JOIN hits h ON h.episode_id = r.episode_id AND h.ref_id = r.ref_id GROUP BY 1)
SELECT e.episode_id, coalesce(rf.miss, 0) AS n_missing, coalesce(na, 0) - coalesce(nb, 0) - coalesce(rf.n, 0) AS n_extra,
       coalesce(chg.n, 0) AS n_changed,
       coalesce(rf.miss, 0) = 0 AND coalesce(na, 0) - coalesce(nb, 0) - coalesce(rf.n, 0) = 0 AND coalesce(chg.n, 0) = 0 AS ok
FROM (SELECT episode_id FROM cnt UNION SELECT episode_id FROM rf) e
LEFT JOIN cnt USING (episode_id) LEFT JOIN chg USING (episode_id) LEFT JOIN rf USING (episode_id)""",
)
def _(spark, sf):
    old, new, refs = added(spark, sf)
    return V.addition_integrity(old, new, refs, ["id", "price", "priority", "day"], ["price", "day"], ["priority"])


@query("J11_row_in", "WITH " + ROWS.strip() + " SELECT episode_id, id, price, priority FROM sides WHERE b > 0 AND a > 0")
def _(spark, sf):
    b, a = before_after(spark, sf)
    return V.rows_in(b, a, COLS)


@query("J11_row_not_in", "WITH " + ROWS.strip() + " SELECT episode_id, id, price, priority FROM sides WHERE b > 0 AND a = 0")
def _(spark, sf):
    b, a = before_after(spark, sf)
    return V.rows_not_in(b, a, COLS)


@query(
    "E22_duplicates",
    """SELECT l_orderkey, l_partkey, count(*) AS copies, min(l_linenumber) AS keep
       FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1""",
)
def _(spark, sf):
    return V.duplicates(A.table(spark, sf, "lineitem"), "l_linenumber", ["l_orderkey", "l_partkey"])


@query(
    "E22_without_duplicates",
    "SELECT p_name, p_brand, p_type, min(p_partkey) AS p_partkey FROM part GROUP BY p_name, p_brand, p_type",
)
def _(spark, sf):
    return V.without_duplicates(A.table(spark, sf, "part"), "p_partkey", ["p_name", "p_brand", "p_type"])


PARTS = """
b AS (SELECT p_size AS episode_id, p_partkey AS id, p_name AS name, p_type AS type FROM part),
a AS (SELECT * FROM b WHERE id IN (SELECT min(id) FROM b GROUP BY episode_id, name, type) OR (type = 'PROMO' AND name LIKE 'red%'))"""


@query(
    "E22_duplicate_removal",
    "WITH " + PARTS.strip() + """,
g AS (SELECT episode_id, name, type, sum(x) AS nb, sum(y) AS na FROM (
        SELECT episode_id, name, type, 1 AS x, 0 AS y FROM b UNION ALL SELECT episode_id, name, type, 0, 1 FROM a) GROUP BY ALL)
SELECT episode_id, count(*) FILTER (nb > 0 AND na = 0) AS n_missing, count(*) FILTER (na > 1) AS n_left, 0 AS n_extra,
       count(*) FILTER (nb > 0 AND na = 0) + count(*) FILTER (na > 1) = 0 AS ok FROM g GROUP BY episode_id""",
)
def _(spark, sf):
    b = A.table(spark, sf, "part").select(
        F.col("p_size").alias(EP), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type")
    )
    keep = V.without_duplicates(b, "id", [EP, "name", "type"]).select("id")
    extra = b.filter("type = 'PROMO' AND name LIKE 'red%'").select("id")
    a = b.join(keep.unionByName(extra).distinct(), "id", "left_semi")
    return V.duplicate_removal(b, a, "id", ["name", "type"])


@query(
    "E23_near_duplicates",
    """SELECT p_name, p_brand, count(*) AS n_parts, count(DISTINCT p_type) AS n_types FROM part
       GROUP BY p_name, p_brand HAVING count(*) > 1 AND count(DISTINCT (p_type, p_size)) = count(*)""",
)
def _(spark, sf):
    # Rows alike in name only must not be reported as duplicates.
    p = A.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    exact = V.duplicates(p, "p_partkey", ["p_name", "p_brand", "p_type", "p_size"]).select("p_name", "p_brand")
    titles = p.groupBy("p_name", "p_brand").agg(
        F.count(F.lit(1)).alias("n_parts"), F.countDistinct("p_type").alias("n_types")
    ).filter("n_parts > 1")
    return titles.join(exact, ["p_name", "p_brand"], "left_anti")


LINES = """
lines AS (
  SELECT l.*, o.o_orderpriority AS priority, row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey)"""


def lines(spark, sf):
    li = A.table(spark, sf, "lineitem").join(
        A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("priority")),
        "l_orderkey",
    )
    out = ordered_columns(
        li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], [row_number("rn")]
    )
    return out.withColumn("pos", F.col("rn") - 1).withColumnRenamed("l_orderkey", EP)


@query(
    "E24_playlist_verify",
    "WITH " + LINES.strip() + """
SELECT l_orderkey AS episode_id, count(*) AS n_rows, count(*) FILTER (l_quantity <= 45) AS n_hit,
       count(*) FILTER (l_quantity <= 45) = count(*) AS ok FROM lines GROUP BY l_orderkey""",
)
def _(spark, sf):
    li = lines(spark, sf)
    file = F.concat(F.lit("part"), F.col("l_partkey").cast("string"), F.lit(".mp4"))
    rows = li.select(EP, F.col("priority").alias("playlist_name"), file.alias("file"), F.col("pos").cast("int").alias("position"))
    wanted = F.when(F.col("l_quantity") <= 45, file).otherwise(F.lit("other.mp4"))
    # An order has a handful of lines.
    expected = li.groupBy(EP).agg(
        F.lower(F.min("priority")).alias("name"),
        F.array_sort(F.collect_list(F.struct("pos", wanted.alias("f"))))["f"].alias("files"),
    )
    out = V.playlist_verify(rows, expected)
    return out.select(EP, F.col("n_rows").cast("long").alias("n_rows"), F.col("n_hit").cast("long").alias("n_hit"), "ok")


@query(
    "E25_newest_deleted",
    "WITH " + LINES.strip() + """,
files AS (SELECT l_orderkey AS episode_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS file, l_shipdate AS changed,
                 l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey
                   ORDER BY l_shipdate DESC, l_linenumber || '-' || l_partkey || '-' || l_suppkey DESC) AS age FROM lines),
diff AS (SELECT *, age = 1 AS newest FROM files WHERE (age = 1 AND q > 10) OR (age > 1 AND q > 48))
SELECT f.episode_id, coalesce(count(d.file), 0) AS n_diff,
       count(d.file) = 1 AND coalesce(bool_or(d.newest), FALSE) AS ok
FROM (SELECT DISTINCT episode_id FROM files) f LEFT JOIN diff d ON d.episode_id = f.episode_id GROUP BY f.episode_id""",
)
def _(spark, sf):
    li = lines(spark, sf).select(
        EP, F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")]).alias("file"),
        F.col("l_shipdate").alias("changed"), F.col("l_quantity").alias("q"),
    )
    newest = li.groupBy(EP).agg(F.max(F.struct("changed", "file")).alias("n"))
    marked = li.join(newest, EP).withColumn("is_newest", F.struct("changed", "file") == F.col("n"))
    after = marked.filter("NOT ((is_newest AND q > 10) OR (NOT is_newest AND q > 48))")
    return V.newest_deleted(li.select(EP, "file", "changed"), after.select(EP, "file", "changed"))


@query(
    "E26_file_moved",
    """SELECT o_custkey AS episode_id, 'o' || o_orderkey AS file, o_orderstatus = 'F' AS ok FROM orders""",
)
def _(spark, sf):
    o = orders(spark, sf).withColumn("file", F.concat(F.lit("o"), F.col("id").cast("string")))
    # F orders moved, O orders stayed, P orders are in both places.
    src = o.filter("status <> 'F'").select(EP, F.lit("inbox").alias("folder"), "file")
    dst = o.filter("status <> 'O'").select(EP, F.lit("done").alias("folder"), "file")
    moves = o.select(EP, "file", F.lit("inbox").alias("src"), F.lit("done").alias("dst"))
    return V.file_moved(moves, src.unionByName(dst))


@query(
    "E26b_initial_state_check",
    """SELECT o_custkey AS episode_id, count(*) AS n_rows, count(*) FILTER (o_orderstatus = 'F') + 4 AS n_expected FROM orders
       GROUP BY 1 HAVING count(*) <> count(*) FILTER (o_orderstatus = 'F') + 4""",
)
def _(spark, sf):
    b = orders(spark, sf)
    want = b.groupBy(EP).agg(F.count_if(F.col("status") == "F").alias("n_targets")).withColumn("n_noise", F.lit(4))
    return V.initial_state(b, want).select(EP, "n_rows", "n_expected")


@query(
    "E26b_candidates_equal",
    """SELECT p_size || '/' || p_brand AS episode_id, count(DISTINCT p_type) = 1 AS ok FROM part GROUP BY 1""",
)
def _(spark, sf):
    p = A.table(spark, sf, "part").withColumn(EP, F.concat_ws("/", "p_size", "p_brand"))
    return V.candidates_equal(p, ["p_type"])


MESSAGES = """
msgs AS (
  SELECT user_id AS episode_id, '+1 ' || k || '-555' AS address,
         CASE WHEN event_type = 'view' THEN 'See you at noon, friend' ELSE 'Other ' || event_type || ' text entirely' END AS body,
         CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS date_ms FROM ev),
checks AS (SELECT user_id AS episode_id, max(CAST(floor(epoch(ts)) AS BIGINT) * 1000) AS now_ms,
                  arg_max('+1' || k || '555', (ts, event_id)) AS number, 'see you at NOON, friend' AS body FROM ev GROUP BY 1)"""


def sms_lines(spark, sf):
    ev = A._events(spark, sf)
    body = F.when(F.col("event_type") == "view", "See you at noon, friend").otherwise(
        F.concat(F.lit("Other "), "event_type", F.lit(" text entirely"))
    )
    line = F.concat(
        F.lit("Row: 0 _id="), F.col("event_id").cast("string"), F.lit(", address=+1 "), F.col("k").cast("string"),
        F.lit("-555, body="), body, F.lit(", date="), (F.unix_seconds("ts") * 1000).cast("string"), F.lit(", read=1"),
    )
    return ev.select("user_id", "event_id", "ts", "k", line.alias("raw"))


@query(
    "E27_message_sent_within",
    "WITH ev AS (" + A.CTE["ev"] + ")," + MESSAGES + """
SELECT c.episode_id, coalesce(bool_or(replace(replace(m.address, ' ', ''), '-', '') = c.number
         AND lower(m.body) = lower(c.body) AND c.now_ms - m.date_ms <= 300000), FALSE) AS ok
FROM checks c JOIN msgs m ON m.episode_id = c.episode_id GROUP BY c.episode_id""",
)
def _(spark, sf):
    raw = sms_lines(spark, sf)
    msgs = raw.select(F.col("user_id").alias(EP), sms_fields(F.col("raw")).alias("m")).select(
        EP, "m.address", "m.body", "m.date_ms"
    )
    checks = raw.groupBy(F.col("user_id").alias(EP)).agg(
        F.max(F.unix_seconds("ts") * 1000).alias("now_ms"),
        F.max_by(F.concat(F.lit("+1"), F.col("k").cast("string"), F.lit("555")), F.struct("ts", "event_id")).alias("number"),
    ).withColumn("body", F.lit("see you at NOON, friend"))
    return V.message_sent(msgs, checks)


@query(
    "E28_contact_exists",
    """SELECT c_custkey AS episode_id, c_name AS name, c_acctbal > 500 AS ok FROM customer""",
)
def _(spark, sf):
    c = A.table(spark, sf, "customer")
    num = F.concat(F.lit("(555) "), F.col("c_custkey").cast("string"))
    have = c.select(F.col("c_custkey").alias(EP), F.col("c_name").alias("name"),
                    F.when(F.col("c_acctbal") > 500, num).otherwise(F.concat(num, F.lit("9"))).alias("number"))
    want = c.select(F.col("c_custkey").alias(EP), F.col("c_name").alias("name"),
                    F.concat(F.lit("555-"), F.col("c_custkey").cast("string")).alias("number"))
    return V.contact_exists(have, want)


@query(
    "E29_number_on_screen",
    """SELECT o_orderkey AS episode_id, o_orderpriority <> '5-LOW' AND coalesce(s.hit, FALSE) AS ok FROM orders
       LEFT JOIN (SELECT l_orderkey, TRUE AS hit FROM lineitem WHERE l_quantity = 7 GROUP BY 1) s ON s.l_orderkey = o_orderkey""",
)
def _(spark, sf):
    el = A.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias(EP), F.concat(F.lit("("), F.col("l_quantity").cast("int").cast("string"), F.lit(") ")).alias("text")
    )
    screens = A.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias(EP),
        F.when(F.col("o_orderpriority") != "5-LOW", "com.google.android.dialer/.Main").otherwise("com.other/.Main").alias("activity"),
        F.lit("no. 7").alias("number"),
    )
    return V.number_on_screen(el, screens)


@query(
    "F17_screen_flag",
    """SELECT l_orderkey AS screen_id, bool_or(starts_with(p_name, 'red')) AS flagged
       FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""",
)
def _(spark, sf):
    from ..operators.filters import screen_flag

    el = A.table(spark, sf, "lineitem").join(
        A.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("text")), "l_partkey"
    )
    return screen_flag(el.select(F.col("l_orderkey").alias("screen_id"), "text"), "red")


# The answer is the order's own value, slightly off, or of another length.
@query(
    "E30_answer_check",
    """SELECT o_orderkey AS episode_id,
              CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
                   WHEN o_orderstatus = 'P' THEN FALSE
                   WHEN o_orderpriority = '1-URGENT' THEN TRUE
                   WHEN o_orderpriority = '2-HIGH' THEN o_totalprice - floor(o_totalprice) < 0.5
                   WHEN o_orderpriority = '3-MEDIUM' THEN month(o_orderdate) = 1
                   WHEN o_orderpriority = '5-LOW' THEN hour(o_orderdate) = 0 END AS ok
       FROM orders""",
)
def _(spark, sf):
    o = A.table(spark, sf, "orders")
    p = F.col("o_orderpriority")
    kind = (
        F.when(p == "1-URGENT", "string").when(p == "2-HIGH", "number").when(p == "3-MEDIUM", "date")
        .when(p == "5-LOW", "time").otherwise("number")
    )
    answer = (
        F.when(p == "1-URGENT", F.lit(" 1-urgent"))
        .when(p == "2-HIGH", F.floor("o_totalprice").cast("string"))
        .when(p == "3-MEDIUM", F.concat(F.lit("January "), F.dayofmonth("o_orderdate").cast("string"), F.lit(" "), F.year("o_orderdate").cast("string")))
        .when(p == "5-LOW", "00:00").otherwise("not a number")
    )
    truth = (
        F.when(p == "1-URGENT", p).when(p == "2-HIGH", F.col("o_totalprice").cast("string"))
        .when(p == "3-MEDIUM", F.date_format("o_orderdate", "MMMM d yyyy")).when(p == "5-LOW", F.date_format("o_orderdate", "HH:mm"))
        .otherwise("1")
    )
    two = F.col("o_orderstatus") == "P"
    answers = o.select(
        F.col("o_orderkey").alias(EP), answer.alias("answer"), kind.alias("match_type"), F.lit(0.5).alias("tolerance")
    ).join(o.select(F.col("o_orderkey").alias(EP), two.alias("two"), truth.alias("t")), EP)
    expected = answers.select(EP, F.when(F.col("two"), F.array("t", "t")).otherwise(F.array("t")).alias("expected"))
    # Unparsable numbers give null, whatever the length.
    return V.answer_check(answers.drop("t", "two"), expected)


TRACK = """
pts AS (SELECT l_orderkey AS episode_id, pos AS seq, l_quantity AS lat, l_linenumber AS lon FROM lines),
way AS (SELECT o_orderkey AS episode_id, unnest([0, 1]) AS i,
               unnest([10.0 + hash_ , 30.0 + hash_]) AS lat FROM (SELECT o_orderkey, o_custkey % 10 AS hash_ FROM orders)),
first AS (SELECT p.episode_id, min(seq) AS at FROM pts p JOIN way w ON w.episode_id = p.episode_id AND w.i = 0
          WHERE abs(p.lat - w.lat) < 8 GROUP BY 1),
second AS (SELECT p.episode_id, min(seq) AS at FROM pts p JOIN first f ON f.episode_id = p.episode_id AND p.seq > f.at
           JOIN way w ON w.episode_id = p.episode_id AND w.i = 1 WHERE abs(p.lat - w.lat) < 8 GROUP BY 1)"""


@query(
    "E31_track_visits_in_order",
    "WITH " + LINES.strip() + "," + TRACK + """
SELECT o_orderkey AS episode_id, CASE WHEN s.at IS NOT NULL THEN 2 WHEN f.at IS NOT NULL THEN 1 ELSE 0 END AS matched,
       s.at IS NOT NULL AS ok FROM orders LEFT JOIN first f ON f.episode_id = o_orderkey LEFT JOIN second s ON s.episode_id = o_orderkey""",
)
def _(spark, sf):
    pts = lines(spark, sf).select(EP, F.col("pos").alias("seq"), F.col("l_quantity").alias("lat"), F.lit(0.0).alias("lon"))
    h = F.pmod("o_custkey", F.lit(10))
    way = A.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias(EP), F.posexplode(F.array(h + 10.0, h + 30.0)).alias("i", "lat")
    ).withColumn("lon", F.lit(0.0))
    return V.track_visits(pts, way, 8.0)


@query(
    "E31_track_visits_row",
    "WITH " + LINES.strip() + "," + TRACK + """
SELECT l_orderkey AS episode_id, s.at IS NOT NULL AS ok FROM (SELECT DISTINCT l_orderkey FROM lineitem)
LEFT JOIN second s ON s.episode_id = l_orderkey""",
)
def _(spark, sf):
    pts = lines(spark, sf).join(
        A.table(spark, sf, "orders").select(F.col("o_orderkey").alias(EP), F.pmod("o_custkey", F.lit(10)).alias("h")), EP
    )
    zero = F.lit(0.0).alias("lon")
    tracks = pts.groupBy(EP, "h").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col("l_quantity").alias("lat"), zero).alias("p"))))["p"].alias("pts")
    )
    targets = F.array(F.struct((F.col("h") + 10.0).alias("lat"), zero), F.struct((F.col("h") + 30.0).alias("lat"), zero))
    return tracks.withColumn("targets", targets).select(EP, V.track_visits_row(F.col("pts"), F.col("targets"), 8.0).alias("ok"))


@query(
    "E33_merged_text_layout",
    """SELECT doc_id, len(t) = 5 AND coalesce(t[2] = '', FALSE) AND coalesce(t[4] = '', FALSE) AS ok
       FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)""",
)
def _(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", V.merged_text_layout(F.col("text")).alias("ok"))


@query(
    "E34_file_content_check",
    """SELECT d.doc_id, d.text = b.text AS ok FROM documents d
       JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""",
)
def _(spark, sf):
    b = A.table(spark, sf, "benchmark").select("item_id", F.regexp_replace("text", "\n", "\r\n").alias("want"))
    # Every document is held against one of the wanted contents.
    d = A.table(spark, sf, "documents").withColumn("item_id", F.col("doc_id") % F.lit(b.count())).join(b, "item_id")
    return d.select("doc_id", V.same_content(F.col("text"), F.col("want"), exact=True).alias("ok"))

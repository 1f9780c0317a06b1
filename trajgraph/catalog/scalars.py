"""Parsing, date, UI and generated-row queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import parsing as P
from ..functions import ui as UI
from ..operators import jobs as K
from ..operators import screens as S
from ..operators import synthetic as Y
from ..plans import adapters as A
from ..plans.adapters import with_ctes
from ..plans.spread import spread
from .registry import query
from .validators import sms_lines

# ------------------------------------------------------------ K01 reply ingest


def replies(spark, sf):
    """Model replies built from events; errors give replies without an action."""
    ev = A._events(spark, sf)
    call = F.concat(
        F.lit('JSONAction(action_type="'), "event_type", F.lit('", index='), F.col("k").cast("string"), F.lit(", target=unknown)")
    )
    body = F.when(F.col("event_type") == "view", F.concat(F.lit('{"action_type": "view", "index": '), F.col("k").cast("string"), F.lit("}")))
    text = F.when(F.col("event_type") == "error", F.lit("I do not know.")).otherwise(
        F.concat(
            F.lit("Reasoning: saw\n"), "event_type", F.lit(" \nAction: "), F.coalesce(body, call),
            F.when(F.col("k") % 2 == 0, "\nResult: TRUE").when(F.col("k") % 3 == 0, "\nresult: false").otherwise(""),
        )
    )
    return ev.select(F.col("event_id").alias("reply_id"), F.concat(F.lit("s"), F.floor(F.col("k") / 10).cast("string")).alias("source"), text.alias("text"), "event_type", "k")


@query(
    "K01_reply_ingest",
    with_ctes(
        "ev",
        """SELECT event_id AS reply_id, 'saw' || chr(10) || event_type AS reason,
                  CASE WHEN event_type <> 'view' AND k % 2 <> 0 AND k % 3 <> 0 THEN event_type END AS action_type,
                  CASE WHEN event_type = 'view' THEN CAST(k AS VARCHAR) END AS json_index,
                  CASE WHEN k % 2 = 0 THEN TRUE WHEN k % 3 = 0 THEN FALSE END AS flag
           FROM ev WHERE event_type <> 'error'""",
    ),
)
def _(spark, sf):
    good, _ = K.reply_ingest(replies(spark, sf).select("reply_id", "source", "text"))
    return good.select(
        "reply_id", "reason", F.try_element_at("call", F.lit("action_type")).alias("action_type"),
        F.get_json_object("json", "$.index").alias("json_index"), "flag",
    )


@query("K01_reply_rejects", with_ctes("ev", "SELECT event_id AS reply_id FROM ev WHERE event_type = 'error'"))
def _(spark, sf):
    return K.reply_ingest(replies(spark, sf).select("reply_id", "source", "text"))[1].select("reply_id")


@query(
    "K01_parse_rate",
    with_ctes(
        "ev",
        """SELECT 's' || (k // 10) AS source, count(*) AS n, round(avg(CAST(event_type <> 'error' AS DOUBLE)), 8) AS rate
           FROM ev GROUP BY 1""",
    ),
)
def _(spark, sf):
    return K.parse_rate(replies(spark, sf)).withColumn("rate", F.round("rate", 8))


@query(
    "U02_parse_kwargs_call",
    with_ctes(
        "ev",
        """SELECT event_id, event_type AS action_type, CAST(k AS VARCHAR) AS idx, CAST(NULL AS VARCHAR) AS target, 3 AS n
           FROM ev WHERE event_type <> 'error'
           UNION ALL SELECT event_id, NULL, NULL, NULL, 0 FROM ev WHERE event_type = 'error'""",
    ),
)
def _(spark, sf):
    from ..functions.udfs import parse_call

    ev = A._events(spark, sf)
    call = F.when(F.col("event_type") == "error", F.lit("JSONAction(")).otherwise(
        F.concat(F.lit('JSONAction(action_type="'), "event_type", F.lit('", index='), F.col("k").cast("string"), F.lit(", target=unknown)"))
    )
    get = lambda name: F.try_element_at("m", F.lit(name))
    return ev.select("event_id", parse_call(call).alias("m")).select(
        "event_id", get("action_type").alias("action_type"), get("index").alias("idx"), get("target").alias("target"), F.size("m").alias("n")
    )


@query(
    "U04_comparison_json",
    with_ctes(
        "ev",
        """SELECT event_id, k % 2 = 0 AND event_type <> 'error' AS same_page,
                  CASE WHEN event_type <> 'error' THEN k END AS candidate FROM ev""",
    ),
)
def _(spark, sf):
    ev = A._events(spark, sf)
    text = F.when(F.col("event_type") == "error", "no {json} here").otherwise(
        F.concat(F.lit('first {"x": {"y": 1}} then {"is_same_page": '), (F.col("k") % 2 == 0).cast("string"),
                 F.lit(', "matched_candidate_index": '), F.col("k").cast("string"), F.lit("} end"))
    )
    return ev.select("event_id", P.comparison_json(text).alias("c")).select("event_id", "c.*")


@query(
    "U06_subgoals",
    with_ctes(
        "ev",
        """SELECT event_id, id, CASE id WHEN 1 THEN event_type ELSE 'then' END AS anchor,
                  CASE id WHEN 1 THEN 'tap ' || k ELSE 'stop' END AS directive, CAST(CASE id WHEN 1 THEN 0.5 ELSE 0.25 END AS DOUBLE) AS confidence
           FROM ev, (SELECT unnest([1, 2]) AS id)""",
    ),
)
def _(spark, sf):
    ev = A._events(spark, sf)
    text = F.concat(
        F.lit("Sub-goal 1:\nAnchor: "), "event_type", F.lit("\nDirective: tap "), F.col("k").cast("string"),
        F.lit("\nConfidence: 0.5\n\nSub-goal 2: \nAnchor: then \nDirective: stop\nConfidence: 0.25"),
    )
    return ev.select("event_id", F.explode(P.subgoals(text)).alias("g")).select("event_id", "g.*")


@query(
    "U06_state_and_tasks",
    with_ctes(
        "ev",
        """SELECT event_id, 'went ' || event_type AS reasoning, CASE WHEN k % 3 = 0 THEN 'BACKTRACK' WHEN k % 3 = 1 THEN 'COMPLETED'
                  ELSE 'CONTINUE' END AS result, 'open ' || event_type || ';close ' || k AS tasks FROM ev""",
    ),
)
def _(spark, sf):
    ev = A._events(spark, sf)
    result = F.when(F.col("k") % 3 == 0, "BACKTRACK").when(F.col("k") % 3 == 1, "COMPLETED").otherwise("UNSURE")
    state = P.state_evaluation(F.concat(F.lit("Reasoning:\n went "), "event_type", F.lit(" \nResult: "), result))
    tasks = P.numbered_tasks(F.concat(F.lit("1. open "), "event_type", F.lit(" \n2.. close "), F.col("k").cast("string")))
    return ev.select("event_id", state.alias("s"), F.array_join(tasks, ";").alias("tasks")).select("event_id", "s.*", "tasks")


@query(
    "U07_element_action_value",
    with_ctes(
        "ev",
        """SELECT event_id, CASE WHEN k % 2 = 0 THEN chr(65 + k % 26) END AS element, upper(event_type) AS action,
                  CAST(k AS VARCHAR) AS value FROM ev""",
    ),
)
def _(spark, sf):
    ev = A._events(spark, sf)
    el = F.when(F.col("k") % 2 == 0, F.char(F.lit(65) + F.col("k") % 26)).otherwise("None")
    text = F.concat(F.lit("noise\nELEMENT: "), el, F.lit("\nACTION: "), F.upper("event_type"), F.lit("\nVALUE: "), F.col("k").cast("string"), F.lit("."))
    return ev.select("event_id", P.element_action_value(text).alias("r")).select("event_id", "r.*")


@query(
    "U33_path_plan_decision",
    with_ctes(
        "ev",
        """SELECT event_id, event_type || ' ' || k AS path, '["' || event_type || '"]' AS plan, k % 2 = 0 AS decision FROM ev""",
    ),
)
def _(spark, sf):
    ev = A._events(spark, sf)
    inner = F.concat_ws(" ", "event_type", F.col("k").cast("string"))
    path = F.when(F.col("k") % 2 == 0, F.concat(F.lit("so <PATH> "), inner, F.lit("\n</PATH> ok"))).otherwise(F.concat(inner, F.lit(" ")))
    plan = F.concat(F.lit('plan:\n```json\n{"task_execution_sequence": ["'), "event_type", F.lit('"]}\n```'))
    verdict = F.concat(F.lit("Because.\nDECISION: "), F.when(F.col("k") % 2 == 0, "True").otherwise("False"), F.lit(" now"))
    return ev.select("event_id", P.path_tag(path).alias("path"), P.plan_json(plan).alias("plan"), P.decision(verdict).alias("decision"))


# ------------------------------------------------------------- K02 dump ingest


@query(
    "K02_dump_messages",
    with_ctes(
        "ev",
        """SELECT event_id AS id, '+1 ' || k || '-555' AS address,
                  CASE WHEN event_type = 'view' THEN 'See you at noon, friend' ELSE 'Other ' || event_type || ' text entirely' END AS body,
                  CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS date_ms FROM ev""",
    ),
)
def _(spark, sf):
    # Each dump repeats its row, as overlapping dumps do.
    raw = sms_lines(spark, sf).select(F.concat("raw", F.lit("\n"), "raw").alias("dump"))
    return K.dump_messages(raw, "dump")


@query(
    "K02_dump_contacts",
    "SELECT c_name AS name, '555' || c_custkey AS number FROM customer UNION SELECT s_name, '1' || s_suppkey FROM supplier",
)
def _(spark, sf):
    line = lambda name, number: F.concat(F.lit("Row: 0 display_name="), name, F.lit(", number="), number)
    c = A.table(spark, sf, "customer").select(line(F.col("c_name"), F.concat(F.lit("(555) "), F.col("c_custkey").cast("string"))).alias("dump"))
    s = A.table(spark, sf, "supplier").select(line(F.col("s_name"), F.concat(F.lit("+1-"), F.col("s_suppkey").cast("string"))).alias("dump"))
    return K.dump_contacts(c.unionByName(s), "dump")


@query(
    "K02_dump_files",
    """SELECT DISTINCT 'note ' || o_orderkey || '.md' AS name, CAST(floor(o_totalprice) AS BIGINT) AS size,
              strftime(o_orderdate, '%Y-%m-%d') AS changed FROM orders""",
)
def _(spark, sf):
    o = A.table(spark, sf, "orders")
    line = F.concat(
        F.lit("total 8\n-rw-rw---- 1 u0_a158 media_rw "), F.floor("o_totalprice").cast("string"), F.lit(" "),
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 12:30:00.123456789 +0000 note "), F.col("o_orderkey").cast("string"),
        F.lit(".md\ndrwx------ 2 root root 4096 2023-01-01 00:00:00.000000000 +0000 dir"),
    )
    out = K.dump_files(o.select(line.alias("dump")), "dump")
    return out.withColumn("changed", F.date_format("changed", "yyyy-MM-dd"))


# ---------------------------------------------------------- K03 screen elements

TAGS = """
raw AS (SELECT page_id, regexp_extract_all(html, '<[A-Za-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>') AS t FROM pages),
tags AS (SELECT page_id, unnest(t) AS tag, unnest(range(0, len(t))) AS idx FROM raw),
named AS (SELECT *, lower(regexp_extract(tag, '^<([A-Za-z0-9]+)', 1)) AS name,
                 nullif(regexp_extract(tag, '\\shref\\s*=\\s*"([^"]*)"', 1), '') AS href,
                 nullif(regexp_extract(tag, '\\sclass\\s*=\\s*"([^"]*)"', 1), '') AS class FROM tags)"""


@query("U11_ui_tree_flatten", "WITH " + TAGS.strip() + " SELECT page_id, idx, name FROM named WHERE href IS NOT NULL OR class IS NOT NULL OR name IN ('img', 'br', 'meta')")
def _(spark, sf):
    nodes = S.tag_nodes(A.table(spark, sf, "pages"), "html", "page_id")
    nodes = nodes.select(
        "page_id", F.col("idx").cast("long").alias("idx"), "name", F.col("name").isin("img", "br", "meta").alias("is_leaf"),
        S.attribute("class").alias("content_description"), S.attribute("href").isNotNull().alias("is_clickable"),
        F.lit(False).alias("is_scrollable"), F.lit(True).alias("is_visible"),
    )
    return S.flatten_nodes(nodes, visible_only=True, clickable=True).select("page_id", "idx", "name")


@query(
    "K03_screen_elements",
    "WITH " + TAGS.strip() + """
    SELECT name || coalesce('_' || replace(class, ' ', ''), '') AS element_key, arg_min(page_id, page_id) AS first_screen, count(*) AS sightings
    FROM named GROUP BY 1""",
)
def _(spark, sf):
    nodes = S.tag_nodes(A.table(spark, sf, "pages"), "html", "page_id")
    key = F.concat("name", F.coalesce(F.concat(F.lit("_"), F.replace(S.attribute("class"), F.lit(" "), F.lit(""))), F.lit("")))
    return S.first_seen(nodes.select(F.col("page_id").alias("screen_id"), key.alias("element_key"), F.col("page_id").alias("seen_at")))


@query(
    "K03_xml_elements",
    """SELECT l_orderkey AS screen_id, CAST(l_linenumber AS VARCHAR) || ' > a & <é> "' || chr(8364) AS text, 'cls.' || l_returnflag AS class_name,
              l_linestatus = 'O' AS is_clickable, CAST(l_quantity AS INT) AS x_min, CAST(l_quantity AS INT) + 10 AS x_max FROM lineitem""",
)
def _(spark, sf):
    q = F.col("l_quantity").cast("int")
    node = F.concat(
        F.lit('<hierarchy rotation="0"><node index="0" text="'), F.col("l_linenumber").cast("string"),
        F.lit(' > a &amp; &lt;&#233;&gt; &quot;&#x20AC;" class="cls.'), "l_returnflag",
        F.lit('" clickable="'), (F.col("l_linestatus") == "O").cast("string"), F.lit('" bounds="['), q.cast("string"), F.lit(",0]["),
        (q + 10).cast("string"), F.lit(',20]" /></hierarchy>'),
    )
    lines = A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    x = spread(lines, "l_orderkey", "l_linenumber").select(F.col("l_orderkey").alias("screen_id"), node.alias("xml"))
    return S.xml_elements(x, "xml", "screen_id").select(
        "screen_id", "text", "class_name", "is_clickable", "bbox_pixels.x_min", "bbox_pixels.x_max"
    )


BOX = "struct(o_orderkey % 300 AS x_min, o_orderkey % 300 + o_custkey % 50 AS x_max, o_orderkey % 700 AS y_min, o_orderkey % 700 + 30 AS y_max)"


@query(
    "U12_bbox_math",
    """SELECT o_orderkey, round((2 * (o_orderkey % 300) + o_custkey % 50) / 2.0, 4) AS center_x, (o_custkey % 50) * 30 AS area,
              round((o_orderkey % 300) / 1080.0, 6) AS nx,
              CASE o_custkey % 4 WHEN 0 THEN CAST(floor(x * 1080 / 1080) AS INT) WHEN 1 THEN 1080 - CAST(floor(y * 1080 / 2400) AS INT)
                WHEN 2 THEN 1080 - x ELSE CAST(floor(y * 1080 / 2400) AS INT) END AS px,
              CASE o_custkey % 4 WHEN 0 THEN y WHEN 1 THEN CAST(floor(x * 2400 / 1080) AS INT) WHEN 2 THEN 2400 - y
                ELSE 2400 - CAST(floor(x * 2400 / 1080) AS INT) END AS py,
              CASE WHEN o_custkey % 4 IN (2, 3) THEN x + o_custkey % 50 ELSE x END AS corner_x
       FROM (SELECT *, o_orderkey % 300 AS x, o_orderkey % 700 AS y FROM orders)""",
)
def _(spark, sf):
    o = A.table(spark, sf, "orders").withColumn("b", F.expr(BOX)).withColumn("turn", F.pmod("o_custkey", F.lit(4)))
    m = UI.box_math(F.col("b"))
    norm = UI.normalise_box(F.col("b"), F.lit(1080), F.lit(2400))
    p = UI.to_physical(F.col("b.x_min"), F.col("b.y_min"), (F.lit(1080), F.lit(2400)), (0, 0, 1080, 2400), F.col("turn"))
    return o.select("o_orderkey", m.alias("m"), norm.alias("n"), p.alias("p"), UI.corners(F.col("b"), F.col("turn")).alias("c")).select(
        "o_orderkey", F.round("m.center_x", 4).alias("center_x"), "m.area", F.round("n.x_min", 6).alias("nx"),
        F.col("p.x").cast("long").alias("px"), F.col("p.y").cast("long").alias("py"), F.col("c.x0").cast("long").alias("corner_x"),
    )


@query(
    "U13_element_key",
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'app.id_' || p_type ELSE p_brand || '_' || p_size || '_30' END
              || CASE WHEN length(p_name) < 10 THEN '_' || replace(p_name, ' ', '') ELSE '' END AS key,
              CASE WHEN p_size % 2 = 0 THEN 'app.id_' || p_type ELSE p_brand || '_' || p_size || '_30' END
              || CASE WHEN length(p_name) < 10 THEN '_' || replace(p_name, ' ', '') ELSE '' END || '_' || md5(p_name) AS uid
       FROM part""",
)
def _(spark, sf):
    p = A.table(spark, sf, "part")
    res = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("app:id/"), "p_type")).otherwise("")
    desc = F.when(F.length("p_name") < 10, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" which is far too long")))
    key = UI.element_key(res, F.col("p_brand"), desc, F.col("p_size"), F.lit(30))
    return p.select("p_partkey", key.alias("key"), UI.element_uid(key, F.md5("p_name")).alias("uid"))


@query(
    "U32_element_description",
    """SELECT p_partkey, CASE p_type
         WHEN 'ECONOMY' THEN '"' || p_name || '" button'
         WHEN 'LARGE' THEN 'a radio button with the text "' || p_name || '" that is ' || CASE WHEN p_size > 25 THEN 'selected' ELSE 'not selected' END
         WHEN 'MEDIUM' THEN 'a "' || p_brand || '" text box' || CASE WHEN p_size > 25 THEN ' with the text "' || p_name || '"' ELSE ' that is empty' END
         WHEN 'PROMO' THEN 'a switch with the text "' || p_name || '" that is ' || CASE WHEN p_size > 25 THEN 'checked' ELSE 'not checked' END
         WHEN 'SMALL' THEN 'Unknown' ELSE '"' || p_name || '" image' END AS description FROM part""",
)
def _(spark, sf):
    t = F.col("p_type")
    big = F.col("p_size") > 25
    cls = (
        F.when(t == "ECONOMY", "android.widget.Button").when(t == "LARGE", "android.widget.RadioButton")
        .when(t == "MEDIUM", "android.widget.EditText").when(t == "PROMO", "android.widget.Switch").when(t == "SMALL", "")
        .otherwise("android.widget.ImageView")
    )
    el = A.table(spark, sf, "part").select(
        "p_partkey", cls.alias("class_name"), F.when((t != "MEDIUM") | big, F.col("p_name")).alias("text"),
        F.lit(None).cast("string").alias("content_description"), F.when(t == "MEDIUM", F.col("p_brand")).alias("hint_text"),
        F.lit(None).cast("string").alias("resource_name"), big.alias("is_checked"), F.lit(True).alias("is_editable"),
    )
    return el.select("p_partkey", UI.element_description().alias("description"))


# ---------------------------------------------------------- K04 dates and times


@query(
    "K04_time_normalise",
    """SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) + (o_custkey % 12) * 3600 + 1800 AS start_s,
              CASE o_orderkey % 3 WHEN 0 THEN 7200 WHEN 1 THEN 5400 ELSE 60 * (o_custkey % 50) END AS duration_s FROM orders""",
)
def _(spark, sf):
    o = A.table(spark, sf, "orders")
    h = F.pmod("o_custkey", F.lit(12))
    clock = F.when(F.col("o_orderkey") % 2 == 0, F.format_string("%02d:30", h)).otherwise(
        F.concat(F.when(h == 0, "12").otherwise(h.cast("string")), F.lit(":30am"))
    )
    length = F.when(F.col("o_orderkey") % 3 == 0, "2h").when(F.col("o_orderkey") % 3 == 1, "1.5 hours").otherwise(
        F.concat(F.pmod("o_custkey", F.lit(50)).cast("string"), F.lit(" minutes"))
    )
    rows = o.select("o_orderkey", F.date_format("o_orderdate", "MMMM d yyyy").alias("d"), clock.alias("t"), length.alias("len"))
    return K.time_normalise(rows, "d", "t", "len").select("o_orderkey", "start_s", "duration_s")


@query(
    "U14_parse_time",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE (CASE WHEN o_orderkey % 4 = 2 THEN 12 ELSE 0 END + o_custkey % 12) * 3600 END AS seconds
       FROM orders""",
)
def _(spark, sf):
    h = F.pmod("o_custkey", F.lit(12))
    twelve = F.when(h == 0, "12").otherwise(h.cast("string"))
    m = F.col("o_orderkey") % 4
    text = F.when(m == 0, F.format_string("%02d:00", h)).when(m == 1, F.concat(twelve, F.lit("AM"))).when(m == 2, F.concat(twelve, F.lit(":00pm"))).otherwise("noon")
    return A.table(spark, sf, "orders").select("o_orderkey", D.parse_time(text).cast("long").alias("seconds"))


@query(
    "U16_to_epoch_localise",
    """SELECT o_orderkey, CAST(epoch(CASE WHEN o_orderstatus = 'P' THEN TIMESTAMP '2023-10-15' ELSE o_orderdate END) AS BIGINT) + 36000 AS epoch_s,
              strftime((CASE WHEN o_orderstatus = 'P' THEN TIMESTAMP '2023-10-15' ELSE o_orderdate END) + INTERVAL 10 HOUR, '%Y-%m-%d %H:%M') AS local
       FROM orders""",
)
def _(spark, sf):
    day = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "MMMM d yyyy"))
    o = A.table(spark, sf, "orders").select("o_orderkey", D.to_epoch(day, F.lit("10am")).alias("epoch_s"))
    return o.withColumn("local", F.date_format(D.localise(F.col("epoch_s")), "yyyy-MM-dd HH:mm"))


@query(
    "U18_relative_date_options",
    with_ctes(
        "ev",
        """SELECT event_id, concat_ws('|', strftime(d, '%B %d'), strftime(d, '%B %d %Y'), CASE WHEN g = 0 THEN 'today' END,
                  CASE WHEN g = 1 THEN 'tomorrow' END, CASE WHEN g = -1 THEN 'yesterday' END,
                  CASE WHEN g BETWEEN 1 AND 7 OR g BETWEEN -7 AND -1 THEN dayname(d) END,
                  CASE WHEN g BETWEEN 1 AND 7 THEN 'this ' || dayname(d) END,
                  CASE WHEN g BETWEEN 8 AND 14 THEN 'the ' || dayname(d) || ' after next' END) AS options
           FROM (SELECT event_id, DATE '2023-10-01' + k % 40 AS d, k % 40 - 14 AS g FROM ev)""",
    ),
)
def _(spark, sf):
    ev = A._events(spark, sf)
    day = F.date_add(F.to_date(F.lit("2023-10-01")), (F.col("k") % 40).cast("int"))
    return ev.select("event_id", F.array_join(D.date_options(day), "|").alias("options"))


@query(
    "U19_weekly_bitmask",
    "SELECT o_orderkey, CAST(1 << (isodow(o_orderdate) - 1) AS INT) AS rule FROM orders",
)
def _(spark, sf):
    return A.table(spark, sf, "orders").select("o_orderkey", D.weekly_bitmask(F.weekday("o_orderdate") + 1).alias("rule"))


@query(
    "U20_unit_rounding",
    "SELECT p_partkey, round_even(round_even(p_retailprice * 7 * (1.0::DOUBLE / 1609.34::DOUBLE), 2) * 1609.34::DOUBLE, 0) AS metres FROM part",
)
def _(spark, sf):
    return A.table(spark, sf, "part").select("p_partkey", D.rounded_metres(F.col("p_retailprice") * 7).alias("metres"))


@query(
    "U21_derived_rows",
    """SELECT p_partkey, p_size AS minutes, CASE p_size % 12 WHEN 1 THEN 'Others' WHEN 2 THEN 'Income' WHEN 3 THEN 'Food' WHEN 4 THEN 'Housing'
         WHEN 5 THEN 'Social' WHEN 6 THEN 'Entertainment' WHEN 7 THEN 'Transportation' WHEN 8 THEN 'Clothes' WHEN 9 THEN 'Health Care'
         WHEN 10 THEN 'Education' WHEN 11 THEN 'Donation' END AS category, p_size / 100 AS dollars FROM part""",
)
def _(spark, sf):
    return A.table(spark, sf, "part").select(
        "p_partkey", K.duration_minutes(F.lit(0), F.col("p_size") * 60).alias("minutes"),
        K.category_name(F.col("p_size") % 12).alias("category"), (F.col("p_size") / 100).alias("dollars"),
    )


@query(
    "U23_md5_key",
    """SELECT n_name, upper(md5(n_name)) AS key, bool_or(contains('/x/' || upper(md5(s_n)) || '_1', substr(upper(md5(n_name)), 1, 16))) AS explored
       FROM nation LEFT JOIN (SELECT 'NATION_' || c_nationkey AS s_n FROM customer WHERE c_acctbal > 9900) ON s_n = n_name GROUP BY ALL""",
)
def _(spark, sf):
    key = F.upper(F.md5("n_name"))
    done = A.table(spark, sf, "customer").filter("c_acctbal > 9900").select(
        F.concat(F.lit("/x/"), F.upper(F.md5(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")))), F.lit("_1")).alias("path")
    )
    # The key starts at a fixed place of the path, so containment is an equi join.
    done = done.select(F.substring("path", 4, 16).alias("head"), F.lit(True).alias("explored")).distinct()
    n = A.table(spark, sf, "nation").select("n_name", key.alias("key"), F.substring(key, 1, 16).alias("head"))
    return n.join(done, "head", "left").select("n_name", "key", "explored")


@query(
    "U25_coords_parse",
    """SELECT c_custkey, CASE WHEN c_nationkey % 3 <> 0 THEN round(c_acctbal / 100, 4) END AS lat,
              CASE WHEN c_nationkey % 3 <> 0 THEN CAST(-c_nationkey AS DOUBLE) END AS lon FROM customer""",
)
def _(spark, sf):
    text = F.concat(
        F.lit("at "), F.format_string("%.4f", F.col("c_acctbal") / 100), F.lit(", -"), F.col("c_nationkey").cast("string"),
        F.when(F.col("c_nationkey") % 3 == 0, ", 7").otherwise(""),
    )
    return A.table(spark, sf, "customer").select("c_custkey", P.coords(text).alias("c")).select("c_custkey", F.round("c.lat", 4).alias("lat"), "c.lon")


@query(
    "U26_steps_of",
    with_ctes(
        "ev",
        """SELECT event_id, CASE WHEN k % 4 = 0 THEN '1,' || (k + 2) WHEN k % 4 = 1 THEN '0' ELSE '' END AS steps FROM ev""",
    ),
)
def _(spark, sf):
    ev = A._events(spark, sf)
    k = F.col("k")
    value = (
        F.when(k % 4 == 0, F.concat(F.lit('{"T": ['), (k + 2).cast("string"), F.lit(", 1, 1]}")))
        .when(k % 4 == 1, F.lit('["T", "U"]')).when(k % 4 == 2, F.lit('{"U": [3]}')).otherwise(F.lit("not json"))
    )
    return ev.select("event_id", F.array_join(P.steps_of(value, F.lit("T")).cast("array<string>"), ",").alias("steps"))


@query(
    "U27_combine_date_time",
    "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) + 3600 * (o_custkey % 24) AS at_s FROM orders",
)
def _(spark, sf):
    day = F.date_format("o_orderdate", "MMMM d yyyy")
    clock = F.format_string("%02d:00", F.pmod("o_custkey", F.lit(24)))
    first = F.when(F.col("o_orderkey") % 2 == 0, day).otherwise(clock)
    second = F.when(F.col("o_orderkey") % 2 == 0, clock).otherwise(day)
    return A.table(spark, sf, "orders").select("o_orderkey", F.unix_seconds(D.combine_date_time(first, second)).alias("at_s"))


@query(
    "U31_action_equal",
    """SELECT a.p_partkey FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1
       WHERE a.p_type = b.p_type AND a.p_name IS NOT DISTINCT FROM b.p_name""",
)
def _(spark, sf):
    p = A.table(spark, sf, "part")
    a = p.select("p_partkey", F.col("p_type").alias("t1"), F.upper("p_name").alias("n1"))
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("t2"), F.col("p_name").alias("n2"))
    same = P.action_equal(
        {"action_type": F.col("t1"), "text": F.col("n1"), "x": F.lit(None).cast("int")},
        {"action_type": F.col("t2"), "text": F.col("n2"), "x": F.lit(None).cast("int")},
    )
    return a.join(b, "p_partkey").filter(same).select("p_partkey")


# ------------------------------------------------- K05 generated rows and states

SEEDED = "CAST('0x' || substr(md5('{seed}_{name}_' || {key}), 1, 8) AS BIGINT)"


@query(
    "U22_instance_seed",
    with_ctes(
        "episodes",
        """SELECT instance_id, CAST('0x' || right(sha256('30_' || coalesce(task_template, 'none') || '_' || instance_id), 8) AS BIGINT) AS seed
           FROM episodes""",
    ),
)
def _(spark, sf):
    e = A.episodes(spark, sf)
    return e.select("instance_id", Y.instance_seed(F.lit(30), F.coalesce("task_template", F.lit("none")), F.col("instance_id")).alias("seed"))


@query(
    "U24_template_fill",
    """SELECT o_orderkey, 'Buy ' || o_orderpriority || ' for ' || c_mktsegment || ' on ' || o_orderstatus AS text
       FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def _(spark, sf):
    c = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    o = A.table(spark, sf, "orders").join(c, "o_custkey")
    params = F.create_map(F.lit("what"), "o_orderpriority", F.lit("who"), "c_mktsegment", F.lit("day"), "o_orderstatus")
    return o.select("o_orderkey", Y.fill_template(F.lit("Buy {what} for {who} on {day}"), params).alias("text"))


@query(
    "U24_without_replacement",
    f"""WITH pool AS (SELECT DISTINCT n_regionkey AS g, n_name AS v FROM nation),
        used AS (SELECT DISTINCT n_regionkey AS g, n_name AS v FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 9000),
        free AS (SELECT * FROM pool EXCEPT SELECT * FROM used)
        SELECT g AS "group", arg_min(v, ({SEEDED.format(seed=7, name='free', key="g || '/' || v")}, v)) AS value FROM free GROUP BY g""",
)
def _(spark, sf):
    n = A.table(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("group"), F.col("n_name").alias("value"), "n_nationkey")
    used = A.table(spark, sf, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey")).join(n, "n_nationkey")
    out = Y.unused_value(n.select("group").distinct(), used.select("group", "value").distinct(), n.select("group", "value").distinct(), 7)
    return out.filter("value IS NOT NULL").select(F.col("group").cast("int").alias("group"), "value")


@query(
    "U34_state_format",
    """SELECT o_orderkey, 'meet ' || o_orderstatus || '|at ' || o_orderpriority AS lines FROM orders""",
)
def _(spark, sf):
    o = A.table(spark, sf, "orders").select(
        "o_orderkey", F.array(F.lit("meet {who}"), F.lit("at {where}")).alias("lines"),
        F.create_map(F.lit("who"), "o_orderstatus", F.lit("where"), "o_orderpriority").alias("params"),
    )
    return Y.fill_fields(o, ["lines"], "params").select("o_orderkey", F.array_join("lines", "|").alias("lines"))


GENERATED = f"""
names AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT p_name AS name FROM part)),
gen AS (
  SELECT o_orderkey AS id, name AS title, 8 + {SEEDED.format(seed=5, name='hour', key='o_orderkey')} % 12 AS hour,
         ['low', 'mid', 'high'][{SEEDED.format(seed=5, name='level', key='o_orderkey')} % 3 + 1] AS level
  FROM orders JOIN names ON {SEEDED.format(seed=5, name='title', key='o_orderkey')} % n = i)"""


def generated(spark, sf):
    base = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    rows = Y.draw(base, "id", A.table(spark, sf, "part"), "p_name", "title", 5)
    return rows.select(
        "id", "title", Y.pick_between(8, 19, F.col("id"), "hour", 5).alias("hour"),
        Y.pick(["low", "mid", "high"], F.col("id"), "level", 5).alias("level"),
    )


@query("K05_synthetic_rows", "WITH " + GENERATED.strip() + " SELECT * FROM gen")
def _(spark, sf):
    return generated(spark, sf)


@query(
    "U30_random_rows",
    "WITH " + GENERATED.strip() + """
    SELECT title, hour, level, min(id) AS id FROM gen WHERE level <> 'low' GROUP BY ALL ORDER BY min(id) LIMIT 75""",
)
def _(spark, sf):
    return Y.random_rows(generated(spark, sf), "id", ["title", "hour", "level"], 75, keep=F.col("level") != "low")


@query(
    "U30b_file_names_and_sums",
    f"""SELECT p_partkey, CASE WHEN {SEEDED.format(seed=3, name='front', key='p_partkey')} % 2 = 0 THEN w || '_' || p_type || '.md'
                ELSE p_type || '_' || w || '.md' END AS file, CAST(list_sum(list_transform(range(1, 5), lambda i: c[i + 1] - c[i])) AS BIGINT) AS total,
               c[2] AS first_part
        FROM (SELECT *, ['backup', 'copy', 'final', 'edited'][{SEEDED.format(seed=3, name='word', key='p_partkey')} % 4 + 1] AS w,
                     list_sort([0, p_size, {SEEDED.format(seed=3, name='a', key='p_partkey')} % (p_size + 1),
                       {SEEDED.format(seed=3, name='b', key='p_partkey')} % (p_size + 1), {SEEDED.format(seed=3, name='c', key='p_partkey')} % (p_size + 1)]) AS c
              FROM part)""",
)
def _(spark, sf):
    key = F.col("p_partkey")
    cuts = F.array(*[F.pmod(Y.seeded(key, n, 3), F.col("p_size") + 1).cast("long") for n in "abc"])
    parts = Y.split_sum(F.col("p_size"), cuts)
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s + x)
    return A.table(spark, sf, "part").select(
        "p_partkey", Y.modified_file_name(F.concat("p_type", F.lit(".md")), key, 3).alias("file"),
        total.alias("total"), parts[0].alias("first_part"),
    )


@query(
    "S20_assemble_state",
    "WITH " + GENERATED.strip() + f""",
    req AS (SELECT o_orderkey AS id, 'required ' || o_orderpriority AS title FROM orders WHERE o_totalprice > 495000)
    SELECT id, title, TRUE AS required, {SEEDED.format(seed=9, name='shuffle', key='id')} AS shuffle_key FROM req
    UNION ALL SELECT id, title, FALSE, {SEEDED.format(seed=9, name='shuffle', key='id')} FROM gen WHERE title NOT IN (SELECT title FROM req) AND NOT (level = 'low' AND hour > 12)""",
)
def _(spark, sf):
    from ..operators.filters import exclusion_filter, without_titles

    required = A.table(spark, sf, "orders").filter("o_totalprice > 495000").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("required "), "o_orderpriority").alias("title")
    )
    noise = exclusion_filter(generated(spark, sf), [("level", "=", "LOW"), ("hour", ">", 12)], text=("level",))
    return Y.assemble_state(required, without_titles(noise.select("id", "title"), required), "id", 9)


@query(
    "S21_record_to_row_events",
    """SELECT CAST(epoch(o_orderdate) AS BIGINT) + 45000 AS start_ts,
              CAST(epoch(o_orderdate) AS BIGINT) + 45000 + CASE WHEN o_orderstatus = 'P' THEN 1800 ELSE 5400 END AS end_ts,
              o_orderpriority AS title, '' AS location, '' AS description FROM orders""",
)
def _(spark, sf):
    r = A.table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "MMMM d yyyy").alias("start_date"), F.lit("12:30").alias("start_time"),
        F.when(F.col("o_orderstatus") != "P", "90m").alias("duration"), F.col("o_orderpriority").alias("title"),
        F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("description"),
    )
    return K.event_rows(r)


@query(
    "S21_record_to_row_tasks",
    """SELECT o_orderpriority AS title, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE o_custkey % 4 END AS importance,
              CASE WHEN o_orderstatus = 'O' THEN 0 ELSE CAST(epoch(o_orderdate) AS BIGINT) * 1000 END AS "dueDate", 0 AS "hideUntil",
              CASE WHEN o_orderstatus = 'F' THEN CAST(epoch(o_orderdate) AS BIGINT) * 1000 ELSE 0 END AS completed,
              CASE WHEN o_orderstatus = 'O' THEN 0 ELSE CAST(epoch(o_orderdate) AS BIGINT) * 1000 END - 25200 AS created FROM orders""",
)
def _(spark, sf):
    day = F.date_format("o_orderdate", "MMMM d yyyy")
    none = F.lit(None).cast("string")
    r = A.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") != "P", F.pmod("o_custkey", F.lit(4)).cast("string")).alias("importance"),
        F.when(F.col("o_orderstatus") != "O", day).alias("due_date"), none.alias("due_time"), none.alias("hide_until_date"), none.alias("hide_until_time"),
        F.when(F.col("o_orderstatus") == "F", day).alias("completed_date"), none.alias("completed_time"), none.alias("notes"),
    )
    return K.task_rows(r).drop("modified", "notes")


@query(
    "S21_record_to_row_activities",
    """SELECT name, starttime, stoptime, totaldistance, round(totaldistance / (totaltime * 1000.0), 12) AS avgspeed FROM (
         SELECT 'run ' || p_partkey AS name, 1697328000000 + 28800000 AS starttime, 1697328000000 + 28800000 + p_size * 60000 AS stoptime,
                p_size * 60000 AS totaltime, round_even(round_even(p_retailprice * 3 * (1.0::DOUBLE / 1609.34::DOUBLE), 2) * 1609.34::DOUBLE, 0) AS totaldistance FROM part)""",
)
def _(spark, sf):
    none = F.lit(None).cast("string")
    r = A.table(spark, sf, "part").select(
        F.concat(F.lit("run "), F.col("p_partkey").cast("string")).alias("name"), F.lit("October 15 2023").alias("start_date"), F.lit("8am").alias("start_time"),
        F.col("p_size").cast("string").alias("duration"), (F.col("p_retailprice") * 3).cast("string").alias("total_distance"),
        none.alias("category"), none.alias("description"), none.alias("elevation_gain"), none.alias("elevation_loss"),
    )
    return K.activity_rows(r).select("name", "starttime", "stoptime", "totaldistance", F.round("avgspeed", 12).alias("avgspeed"))


@query(
    "U28_normalise_note",
    """SELECT n_nationkey AS parent_id, lower(c_name) AS title, c_mktsegment AS body, CAST(c_acctbal > 0 AS INT) AS is_todo, 0 AS todo_completed
       FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def _(spark, sf):
    n = A.table(spark, sf, "nation").select(F.col("n_name").alias("folder"), F.col("n_nationkey").alias("parent_id"))
    r = A.table(spark, sf, "customer").select(
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("folder"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("body"),
        F.when(F.col("c_acctbal") > 0, "True").otherwise("no").alias("is_todo"), F.lit(None).cast("string").alias("todo_completed"),
    )
    return K.note_rows(r, n)


@query(
    "S15_rows_to_text",
    """SELECT c_custkey || '|' || c_name || '|' || CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'None' END AS value FROM customer""",
)
def _(spark, sf):
    c = A.table(spark, sf, "customer").withColumn("seg", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")))
    return K.csv_rows(c, ["c_custkey", "c_name", "seg"])


@query(
    "S15_text_blocks",
    """SELECT 'Expense: ' || c_name || chr(10) || ' c_custkey: ' || c_custkey || chr(10) || ' c_mktsegment: ' || c_mktsegment || chr(10) AS value FROM customer""",
)
def _(spark, sf):
    return K.text_blocks(A.table(spark, sf, "customer"), "Expense", "c_name", ["c_custkey", "c_name", "c_mktsegment"])


@query(
    "S22_family_select",
    "SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'LARGE')",
)
def _(spark, sf):
    members = A.table(spark, sf, "part").withColumn("registry", F.lower("p_type"))
    return K.families(members, "all", {"all": ("promo", "large"), "promo": ("promo",)}).select("p_partkey")

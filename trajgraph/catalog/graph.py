"""Graph memory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..plans import adapters as A
from ..plans.adapters import with_ctes
from ..plans.checkpoints import scratch
from ..plans.ordered import lead, ordered_columns
from ..sources.samples import write_graph
from .registry import query

# ------------------------------------------------------ node tables from events


def summary_of(page):
    return F.when(page.startswith("signup"), F.lit(None)).when(page.startswith("error"), F.lit("")).otherwise(
        F.concat(F.lit("Screen "), page)
    )


def tables(spark, sf):
    e = A.shared_edges(spark, sf)
    page_steps = (
        e.select(F.col("src").alias("page_id"), "task", "step")
        .unionByName(e.select(F.col("tgt").alias("page_id"), "task", (F.col("step") + 1).alias("step")))
        .distinct()
    )
    pages = page_steps.select("page_id").distinct().withColumn("function_summary", summary_of(F.col("page_id")))
    pages = pages.withColumn(
        "goal", F.when(F.col("page_id").startswith("purchase"), F.concat(F.lit("buy at "), "page_id")).otherwise("")
    )
    elements = (
        e.select(F.col("elem").alias("element_id"), F.col("tgt"))
        .distinct()
        .select(
            "element_id",
            F.when(~F.col("tgt").startswith("view"), F.concat(F.lit("go to "), "tgt")).alias("function_summary"),
            F.when(F.col("tgt").startswith("click"), F.concat(F.lit("open "), "tgt")).otherwise("").alias("goal"),
        )
    )
    return {
        "edges": e,
        "pages": pages,
        "elements": elements,
        "has_element": e.select(F.col("src").alias("page_id"), F.col("elem").alias("element_id")).distinct(),
        "leads_to": e.select(F.col("elem").alias("element_id"), F.col("tgt").alias("page_id")).distinct(),
        "page_steps": page_steps,
        "element_steps": e.select(F.col("elem").alias("element_id"), "task", "step").distinct(),
    }


NODES = """
page_steps AS (
  SELECT src AS page_id, task, step FROM edges UNION SELECT tgt, task, step + 1 FROM edges),
has_element AS (SELECT DISTINCT src AS page_id, elem AS element_id FROM edges),
leads_to AS (SELECT DISTINCT elem AS element_id, tgt AS page_id FROM edges),
pages_ AS (
  SELECT page_id,
         CASE WHEN page_id LIKE 'signup%' THEN NULL WHEN page_id LIKE 'error%' THEN ''
              ELSE 'Screen ' || page_id END AS function_summary,
         CASE WHEN page_id LIKE 'purchase%' THEN 'buy at ' || page_id ELSE '' END AS goal
  FROM (SELECT DISTINCT page_id FROM page_steps)),
elements_ AS (
  SELECT element_id, CASE WHEN tgt NOT LIKE 'view%' THEN 'go to ' || tgt END AS function_summary,
         CASE WHEN tgt LIKE 'click%' THEN 'open ' || tgt ELSE '' END AS goal
  FROM (SELECT DISTINCT elem AS element_id, tgt FROM edges))"""


def composites(spark, sf):
    """Composite actions: adjacent edges of a trajectory."""
    e = A.edges(spark, sf)
    pairs = ordered_columns(
        e, ["task", "branch"], ["step"], [lead("elem2", "elem"), lead("tgt2", "tgt"), lead("k2", "k")]
    ).filter(F.col("elem2").isNotNull())
    return pairs.groupBy(
        F.concat(F.lit("A:"), "elem", F.lit("+"), "elem2").alias("action_id")
    ).agg(
        F.min(
            F.array(F.concat_ws(",", "src", "elem", "tgt"), F.concat_ws(",", "tgt", "elem2", "tgt2"))
        ).alias("components"),
        F.concat(F.lit("go "), F.min("tgt2")).alias("name"),
        F.when(F.min("k2") % 3 != 0, F.concat(F.lit("via "), F.min("tgt"))).alias("description"),
        (F.min("k2") >= 50).alias("is_high_level"),
    )


COMPOSITES = """
composites AS (
  SELECT 'A:' || elem || '+' || elem2 AS action_id,
         min([src || ',' || elem || ',' || tgt, tgt || ',' || elem2 || ',' || tgt2]) AS components,
         'go ' || min(tgt2) AS name,
         CASE WHEN min(k2) % 3 <> 0 THEN 'via ' || min(tgt) END AS description,
         min(k2) >= 50 AS is_high_level
  FROM (SELECT *, lead(elem) OVER w AS elem2, lead(tgt) OVER w AS tgt2, lead(k) OVER w AS k2 FROM edges
        WINDOW w AS (PARTITION BY task, branch ORDER BY step))
  WHERE elem2 IS NOT NULL GROUP BY 1),
composed AS (
  SELECT action_id, 0 AS "order", string_split(components[1], ',')[2] AS element_id FROM composites
  UNION ALL SELECT action_id, 1, string_split(components[2], ',')[2] FROM composites)"""


# -------------------------------------------------------------------- upserts


@query(
    "G01_merge_edges",
    with_ctes(
        "edges",
        """SELECT src, elem, tgt FROM edges
           WHERE src IN (SELECT page_id FROM pages_ WHERE function_summary IS NOT NULL)
             AND tgt IN (SELECT page_id FROM pages_ WHERE function_summary IS NOT NULL)
           GROUP BY ALL""",
        extra=NODES,
    ),
)
def _(spark, sf):
    t = tables(spark, sf)
    known = t["pages"].filter(F.col("function_summary").isNotNull())
    new = t["edges"].select("src", "elem", "tgt")
    return G.merge_edges(
        None, new, ["src", "elem", "tgt"], [(known, "page_id", "src"), (known, "page_id", "tgt")]
    )


@query(
    "G02_append_task_step",
    with_ctes(
        "edges",
        """SELECT page_id AS node_id, task, string_agg(CAST(step AS VARCHAR), ',' ORDER BY step) AS steps
           FROM page_steps GROUP BY ALL""",
        extra=NODES,
    ),
)
def _(spark, sf):
    e = A.edges(spark, sf)
    base = G.merge_task_steps(
        e.select(F.col("src").alias("node_id"), "task", "step"),
        e.select(F.col("tgt").alias("node_id"), "task", (F.col("step") + 1).alias("step")),
    )
    return G.task_step_map(base).withColumn(
        "steps", F.array_join(F.col("steps").cast("array<string>"), ",")
    )


@query(
    "G03_append_goal",
    with_ctes(
        "steps",
        """SELECT page AS node_id, task AS goal, min(event_id) AS seq FROM steps GROUP BY ALL""",
    ),
)
def _(spark, sf):
    s = A.steps(spark, sf)
    return G.append_goals(
        s.select(F.col("page").alias("node_id"), F.col("task").alias("goal"), F.col("event_id").alias("seq"))
    )


@query(
    "G04_fold_trajectories",
    with_ctes(
        "steps",
        """SELECT DISTINCT src AS page_id, sha256(src || chr(1) || action) AS element_id, tgt AS target,
                  action AS action_name FROM walk""",
        extra="""
walk AS (
  SELECT coalesce(lag(next_page) OVER (PARTITION BY task, branch ORDER BY step), page) AS src,
         next_page AS tgt, event_type || '>' || next_type AS action
  FROM steps WHERE next_page IS NOT NULL AND next_page <> page)""",
    ),
)
def _(spark, sf):
    s = A.steps(spark, sf).select(
        "task", "branch", "step", F.col("page").alias("before_hash"), F.col("next_page").alias("after_hash"),
        F.concat_ws(">", "event_type", "next_type").alias("action"), F.col("task").alias("goal"),
    )
    g = G.fold_trajectories(s)
    return g["has_element"].join(
        g["leads_to"].select("element_id", F.col("page_id").alias("target"), "action_name"), "element_id"
    )


# Days of a user as nested branches: the first ten days of a month stand above the next ten, and those above the rest.
NESTED = """
placed AS (
  SELECT task, left(branch, 7) || CASE WHEN right(branch, 2) <= '10' THEN '' WHEN right(branch, 2) <= '20' THEN '/a' ELSE '/a/b' END AS branch,
         row_number() OVER (PARTITION BY task, left(branch, 7), right(branch, 2) <= '10', right(branch, 2) <= '20' ORDER BY branch, step) AS n,
         page, next_page, event_type || '>' || next_type AS action FROM steps WHERE next_page IS NOT NULL AND next_page <> page),
marked AS (
  SELECT *, max(n) OVER (PARTITION BY task, branch) AS last_n,
         NOT EXISTS (SELECT 1 FROM placed d WHERE d.task = p.task AND starts_with(d.branch, p.branch || '/')) AS is_leaf FROM placed p),
made AS (SELECT *, CASE WHEN is_leaf AND n = last_n THEN 'leaf/' || task || '/' || branch ELSE next_page END AS tgt FROM marked),
ends AS (SELECT task, branch, arg_max(tgt, n) AS last_page, count(*) AS cnt FROM made GROUP BY ALL),
above AS (
  SELECT e.task, e.branch, arg_max(u.last_page, length(u.branch)) AS start_page, sum(u.cnt) AS start_depth
  FROM ends e JOIN ends u ON u.task = e.task AND starts_with(e.branch, u.branch || '/') GROUP BY ALL),
walk AS (
  SELECT m.task, m.branch, n - 1 + coalesce(start_depth, 0) AS step, tgt, action,
         coalesce(lag(tgt) OVER (PARTITION BY m.task, m.branch ORDER BY n), start_page, page) AS src
  FROM made m LEFT JOIN above USING (task, branch))"""


def _nested(spark, sf):
    s = A.steps(spark, sf)
    month, day = F.substring("branch", 1, 7), F.substring("branch", 9, 2)
    path = F.concat(month, F.when(day <= "10", "").when(day <= "20", "/a").otherwise("/a/b"))
    rows = s.filter(F.col("next_page").isNotNull()).select(
        "task", path.alias("branch"), F.concat_ws("|", "branch", F.lpad(F.col("step").cast("string"), 9, "0")).alias("step"),
        F.col("page").alias("before_hash"), F.col("next_page").alias("after_hash"),
        F.concat_ws(">", "event_type", "next_type").alias("action"), F.col("task").alias("goal"),
    ).filter(F.col("before_hash") != F.col("after_hash"))
    known = rows.select("task", "branch").distinct()
    above = F.explode(F.array(F.regexp_replace("branch", "/[^/]*$", ""), F.regexp_replace("branch", "/.*$", "")))
    inner = known.filter(F.contains("branch", F.lit("/"))).select("task", above.alias("branch")).distinct()
    leaves = known.join(inner, ["task", "branch"], "left_anti").withColumn("is_leaf", F.lit(True))
    return G.fold_trajectories(rows.join(leaves, ["task", "branch"], "left"))


@query(
    "G04_fold_branches",
    with_ctes(
        "steps",
        """SELECT src AS node_id, task, CAST(step AS BIGINT) AS step FROM walk UNION SELECT tgt, task, CAST(step + 1 AS BIGINT) FROM walk""",
        extra=NESTED,
    ),
)
def _(spark, sf):
    return _nested(spark, sf)["page_steps"]


@query(
    "G04_fold_placeholders",
    with_ctes(
        "steps",
        "SELECT page_id, page_id NOT IN (SELECT src FROM walk) AS is_placeholder FROM (SELECT src AS page_id FROM walk UNION SELECT tgt FROM walk)",
        extra=NESTED,
    ),
)
def _(spark, sf):
    return _nested(spark, sf)["pages"]


@query(
    "G04_fold_page_steps",
    with_ctes(
        "steps",
        """SELECT src AS node_id, task, step FROM walk UNION SELECT tgt, task, step + 1 FROM walk""",
        extra="""
walk AS (
  SELECT task, row_number() OVER w - 1 AS step, coalesce(lag(next_page) OVER w, page) AS src,
         next_page AS tgt
  FROM steps WHERE next_page IS NOT NULL AND next_page <> page
  WINDOW w AS (PARTITION BY task, branch ORDER BY step))""",
    ),
)
def _(spark, sf):
    s = A.steps(spark, sf).select(
        "task", "branch", "step", F.col("page").alias("before_hash"), F.col("next_page").alias("after_hash"),
        F.concat_ws(">", "event_type", "next_type").alias("action"), F.col("task").alias("goal"),
    )
    return G.fold_trajectories(s)["page_steps"]


@query(
    "F01_noop_transition_filter",
    with_ctes(
        "steps",
        "SELECT event_id, page, next_page FROM steps WHERE next_page IS NOT NULL AND page <> next_page",
    ),
)
def _(spark, sf):
    return (
        A.steps(spark, sf)
        .filter(G.valid_transition("page", "next_page"))
        .select("event_id", "page", "next_page")
    )


@query(
    "G06_fill_placeholder_page",
    with_ctes(
        "edges",
        """SELECT p.page_id, coalesce(o.elements, 'no transition occurred') AS elements
           FROM pages_ p LEFT JOIN (
             SELECT src AS page_id, arg_min(elem, (ts, elem)) AS elements FROM edges GROUP BY src) o
           ON o.page_id = p.page_id""",
        extra=NODES,
    ),
)
def _(spark, sf):
    t = tables(spark, sf)
    pages = t["pages"].select("page_id", F.lit("no transition occurred").alias("elements"))
    seen = t["edges"].select(
        F.col("src").alias("page_id"), F.col("elem").alias("elements"), F.struct("ts", "elem").alias("seq")
    )
    return G.fill_placeholder_pages(pages, seen)


@query(
    "G07_set_property",
    with_ctes(
        "edges",
        """SELECT p.page_id, CASE WHEN u.n IS NULL THEN p.function_summary
                  ELSE '{"visits":' || u.n || '}' END AS function_summary
           FROM pages_ p LEFT JOIN (
             SELECT src, count(*) AS n FROM edges GROUP BY src HAVING count(*) > 5) u ON u.src = p.page_id""",
        extra=NODES,
    ),
)
def _(spark, sf):
    t = tables(spark, sf)
    updates = (
        t["edges"].groupBy(F.col("src").alias("node_id"))
        .agg(F.count(F.lit(1)).alias("visits"))
        .filter("visits > 5")
        .select("node_id", F.struct("visits").alias("value"))
    )
    return G.set_property(t["pages"].drop("goal"), updates, "page_id", "function_summary")


@query(
    "G08_delete_nodes",
    with_ctes(
        "edges",
        """SELECT src, elem, tgt FROM edges
           WHERE src NOT IN (SELECT page_id FROM pages_ WHERE function_summary IS NULL)
             AND tgt NOT IN (SELECT page_id FROM pages_ WHERE function_summary IS NULL) GROUP BY ALL""",
        extra=NODES,
    ),
)
def _(spark, sf):
    t = tables(spark, sf)
    ids = t["pages"].filter(F.col("function_summary").isNull()).select(F.col("page_id").alias("node_id"))
    e = t["edges"].select("src", "elem", "tgt").distinct()
    _, (by_src,) = G.delete_nodes(t["pages"], "page_id", ids, [(e, "src")])
    _, (left,) = G.delete_nodes(t["pages"], "page_id", ids, [(by_src, "tgt")])
    return left


CASCADE = NODES + """,
forgotten AS (SELECT task FROM steps GROUP BY task HAVING count(*) < 66),
node_tasks AS (SELECT DISTINCT page_id AS node_id, task FROM page_steps),
left_over AS (SELECT * FROM node_tasks WHERE task NOT IN (SELECT task FROM forgotten))"""


def _cascade(spark, sf):
    t = tables(spark, sf)
    forgotten = A.steps(spark, sf).groupBy("task").count().filter("count < 66")
    node_tasks = t["page_steps"].select(F.col("page_id").alias("node_id"), "task").distinct()
    vectors = t["pages"].select(F.col("page_id").alias("id"))
    return G.delete_task_cascade(node_tasks, vectors, forgotten)


@query("G09_delete_task_cascade", with_ctes("edges", "SELECT node_id, task FROM left_over", extra=CASCADE))
def _(spark, sf):
    return _cascade(spark, sf)[0].select("node_id", "task")


@query(
    "G09_cascade_vectors",
    with_ctes(
        "edges",
        "SELECT page_id AS id FROM pages_ WHERE page_id IN (SELECT node_id FROM left_over)",
        extra=CASCADE,
    ),
)
def _(spark, sf):
    return _cascade(spark, sf)[2]


@query(
    "G10_task_names",
    with_ctes("edges", "SELECT DISTINCT task FROM edges"),
)
def _(spark, sf):
    t = tables(spark, sf)
    return G.task_names(t["page_steps"], t["element_steps"])


@query(
    "G11_add_other_info",
    with_ctes(
        "steps",
        """SELECT page AS node_id, step, task, min(branch) AS description FROM steps GROUP BY ALL""",
    ),
)
def _(spark, sf):
    s = A.steps(spark, sf).select(
        F.col("page").alias("node_id"), "step", "task", F.col("branch").alias("description")
    )
    return G.add_other_info(s.limit(0), s)


@query(
    "G12_page_tasks",
    with_ctes(
        "steps", "SELECT DISTINCT page AS page_id, branch AS description FROM steps WHERE step = 0"
    ),
)
def _(spark, sf):
    info = A.steps(spark, sf).select(
        F.col("page").alias("page_id"),
        F.to_json(F.array(F.struct("step", F.struct(F.col("branch").alias("description")).alias("task_info")))).alias(
            "other_info"
        ),
    )
    schema = "array<struct<step:int,task_info:struct<description:string>>>"
    return (
        info.select("page_id", F.explode(F.from_json("other_info", schema)).alias("i"))
        .filter("i.step = 0")
        .select("page_id", F.col("i.task_info.description").alias("description"))
        .distinct()
    )


@query(
    "F09_pages_with_step_zero",
    with_ctes("steps", "SELECT DISTINCT page AS page_id FROM steps WHERE step = 0"),
)
def _(spark, sf):
    info = A.steps(spark, sf).select(
        F.col("page").alias("page_id"), F.to_json(F.array(F.struct("step", "task"))).alias("other_info")
    )
    schema = "array<struct<step:int>>"
    zero = F.exists(F.from_json("other_info", schema), lambda x: x["step"] == 0)
    return info.filter(zero).select("page_id").distinct()


@query(
    "G13_task_trajectory",
    with_ctes(
        "edges",
        """SELECT task, src AS page_id, elem AS element_id,
                  row_number() OVER (PARTITION BY task ORDER BY ts, step) AS rank FROM edges""",
    ),
)
def _(spark, sf):
    walk = A.edges(spark, sf).select(
        "task", F.col("src").alias("page_id"), F.col("elem").alias("element_id"), "ts", F.col("step").alias("order")
    )
    return G.task_trajectory(walk).select("task", "page_id", "element_id", "rank")


@query(
    "G14_shortcuts",
    with_ctes(
        "edges",
        """SELECT 'S:' || action_id AS shortcut_id, action_id, name FROM composites WHERE is_high_level""",
        extra=COMPOSITES,
    ),
)
def _(spark, sf):
    c = composites(spark, sf)
    nodes = c.filter("is_high_level").select(
        F.concat(F.lit("S:"), "action_id").alias("shortcut_id"), "action_id"
    )
    return G.shortcuts(nodes, c.select("action_id", "name"))


@query(
    "G15_rewrite_ids",
    with_ctes(
        "edges",
        """SELECT sha256('v1' || chr(1) || action_id) AS action_id, element_id, "order" FROM composed""",
        extra=COMPOSITES,
    ),
)
def _(spark, sf):
    c = composites(spark, sf)
    _, relinked = G.rewrite_ids(c, "action_id", G.composed_of(c), "action_id", salt="v1")
    return relinked


ACTION_KEY = """
keyed AS (
  SELECT action_id, components[1] || ';' || string_split(components[2], ',')[1] || ','
         || string_split(components[2], ',')[2] || ',*' AS key FROM composites)"""


@query(
    "G16_action_duplicate",
    with_ctes(
        "edges",
        """SELECT key, count(*) AS copies, min(action_id) AS first_action FROM keyed GROUP BY key""",
        extra=COMPOSITES + "," + ACTION_KEY,
    ),
)
def _(spark, sf):
    c = composites(spark, sf)
    return c.groupBy(G.action_key(F.col("components")).alias("key")).agg(
        F.count(F.lit(1)).alias("copies"), F.min("action_id").alias("first_action")
    )


@query(
    "G17_create_actions",
    with_ctes(
        "edges",
        """SELECT min(action_id) AS action_id, key FROM keyed
           WHERE key NOT IN (SELECT k.key FROM keyed k JOIN composites c ON c.action_id = k.action_id
                             WHERE c.is_high_level) GROUP BY key""",
        extra=COMPOSITES + "," + ACTION_KEY,
    ),
)
def _(spark, sf):
    c = composites(spark, sf)
    return G.create_actions(c.filter("is_high_level"), c.select("action_id", "components")).select("action_id", "key")


@query(
    "G17_composed_of",
    with_ctes("edges", """SELECT action_id, "order", element_id FROM composed""", extra=COMPOSITES),
)
def _(spark, sf):
    return G.composed_of(composites(spark, sf))


@query(
    "G18_edge_exists",
    with_ctes(
        "edges",
        """SELECT DISTINCT p.elem AS element_id, p.next_tgt AS page_id
           FROM (SELECT elem, lead(tgt) OVER (PARTITION BY task, branch ORDER BY step) AS next_tgt FROM edges) p
           WHERE EXISTS (SELECT 1 FROM edges e WHERE e.elem = p.elem AND e.tgt = p.next_tgt)""",
    ),
)
def _(spark, sf):
    e = A.edges(spark, sf)
    probes = ordered_columns(e, ["task", "branch"], ["step"], [lead("page_id", "tgt")]).select(
        F.col("elem").alias("element_id"), "page_id"
    )
    known = e.select(F.col("elem").alias("element_id"), F.col("tgt").alias("page_id"))
    return probes.distinct().join(known, ["element_id", "page_id"], "left_semi")


def _typed(spark, sf):
    ev = A.steps(spark, sf).select(
        F.col("event_id"),
        F.when(F.col("event_type") != "error", F.col("page")).alias("description"),
        F.when(F.col("k") % 2 == 0, F.col("ts")).alias("timestamp"),
        F.struct("event_type", "k").alias("detail"),
    )
    return G.checked_nodes(ev, ["description"], ["detail"], F.lit("2023-10-15 15:34:00").cast("timestamp"))


@query(
    "G19_typed_create",
    with_ctes(
        "steps",
        """SELECT event_id, page AS description,
                  CAST(floor(epoch(CASE WHEN k % 2 = 0 THEN ts ELSE TIMESTAMP '2023-10-15 15:34:00' END))
                    AS BIGINT) AS created_s,
                  '{"event_type":"' || event_type || '","k":' || k || '}' AS detail
           FROM steps WHERE event_type <> 'error'""",
    ),
)
def _(spark, sf):
    good, _ = _typed(spark, sf)
    return good.select(
        "event_id", "description", F.unix_seconds("timestamp").alias("created_s"), "detail"
    )


@query("G19_rejected", with_ctes("steps", "SELECT event_id FROM steps WHERE event_type = 'error'"))
def _(spark, sf):
    return _typed(spark, sf)[1].select("event_id")


@query(
    "G20_element_action_decode",
    with_ctes(
        "steps",
        """SELECT event_id, CASE WHEN event_type = 'click' THEN 'tap' WHEN event_type = 'view' THEN 'text' END AS kind,
                  CASE WHEN event_type = 'click' THEN round(k / 100.0 * 1080, 3) END AS x,
                  CASE WHEN event_type = 'view' THEN page END AS text
           FROM steps""",
    ),
)
def _(spark, sf):
    # Stored parameters use several names for the same two actions.
    kind = F.when(F.col("event_type") == "click", "Click").when(F.col("event_type") == "view", "type").otherwise("wait")
    params = F.to_json(
        F.struct(
            kind.alias("action_type"), (F.col("k") / 100).alias("x"), F.lit(0.5).alias("y"), F.col("page").alias("text")
        )
    )
    rows = A.steps(spark, sf).select("event_id", params.alias("params"))
    act = G.element_action(F.col("params"), F.lit(1080), F.lit(2400))
    return rows.select("event_id", act.alias("a")).select(
        "event_id", "a.kind", F.round("a.x", 3).alias("x"), "a.text"
    )


# -------------------------------------------------------------------- lookups


@query(
    "F07_pending_nodes",
    with_ctes(
        "edges",
        "SELECT page_id FROM pages_ WHERE coalesce(function_summary, '') = ''",
        extra=NODES,
    ),
)
def _(spark, sf):
    return G.pending_nodes(tables(spark, sf)["pages"], "function_summary").select("page_id")


@query(
    "E06_node_stats",
    with_ctes(
        "edges",
        """SELECT kind, count(*) AS total, count(nullif(s, '')) AS processed,
                  count(*) - count(nullif(s, '')) AS pending
           FROM (SELECT 'Page' AS kind, function_summary AS s FROM pages_
                 UNION ALL SELECT 'Element', function_summary FROM elements_) GROUP BY kind""",
        extra=NODES,
    ),
)
def _(spark, sf):
    t = tables(spark, sf)
    return G.node_stats({"Page": t["pages"], "Element": t["elements"]}, "function_summary")


@query(
    "F08_start_pages",
    with_ctes(
        "edges",
        """SELECT page_id FROM (
             SELECT src || '@' || task AS page_id, step FROM edges
             UNION SELECT tgt || '@' || task, step + 1 FROM edges)
           GROUP BY page_id HAVING max(step) = 0 AND min(step) = 0""",
    ),
)
def _(spark, sf):
    # Pages are scoped to their task here, since every global page is reused.
    scoped = tables(spark, sf)["page_steps"].withColumn("page_id", F.concat_ws("@", "page_id", "task"))
    return G.start_pages(scoped)


@query(
    "F10_chain_roots",
    with_ctes(
        "edges",
        "SELECT DISTINCT src || '@' || task AS page_id FROM edges e WHERE NOT EXISTS "
        "(SELECT 1 FROM edges f WHERE f.task = e.task AND f.tgt = e.src)",
    ),
)
def _(spark, sf):
    e = A.edges(spark, sf)
    pages = e.select(F.concat_ws("@", "src", "task").alias("page_id")).distinct()
    return G.chain_roots(pages, e.select(F.concat_ws("@", "tgt", "task").alias("page_id")))


@query(
    "F10_chain_ends",
    with_ctes(
        "edges",
        "SELECT DISTINCT tgt || '@' || task AS page_id FROM edges e WHERE NOT EXISTS "
        "(SELECT 1 FROM edges f WHERE f.task = e.task AND f.src = e.tgt)",
    ),
)
def _(spark, sf):
    e = A.edges(spark, sf)
    pages = e.select(F.concat_ws("@", "tgt", "task").alias("page_id")).distinct()
    return G.chain_ends(pages, e.select(F.concat_ws("@", "src", "task").alias("page_id")))


@query(
    "F18_leaf_page",
    with_ctes(
        "edges",
        """SELECT DISTINCT tgt || '@' || task AS page_id FROM edges e
           WHERE NOT EXISTS (SELECT 1 FROM edges f WHERE f.task = e.task AND f.src = e.tgt AND f.k < 50)
             AND NOT EXISTS (SELECT 1 FROM edges f WHERE f.task = e.task AND f.src = e.tgt AND f.k >= 75)""",
    ),
)
def _(spark, sf):
    e = A.edges(spark, sf)
    page = F.concat_ws("@", "src", "task").alias("page_id")
    pages = e.select(F.concat_ws("@", "tgt", "task").alias("page_id")).distinct()
    return G.leaf_pages(pages, e.filter("k < 50").select(page), e.filter("k >= 75").select(page))


@query(
    "F11_keyword_actions",
    with_ctes(
        "edges",
        """SELECT action_id, name FROM composites WHERE is_high_level
           AND (contains(name, 'purchase') OR coalesce(contains(description, 'purchase'), FALSE))""",
        extra=COMPOSITES,
    ),
)
def _(spark, sf):
    return G.keyword_actions(composites(spark, sf), "purchase").select("action_id", "name")


@query(
    "F11_keyword_fallback",
    with_ctes(
        "edges", "SELECT action_id, name FROM composites WHERE is_high_level", extra=COMPOSITES
    ),
)
def _(spark, sf):
    return G.keyword_actions(composites(spark, sf), "no such action").select("action_id", "name")


@query(
    "F12_prefix_match",
    with_ctes(
        "edges",
        """SELECT p.page_id, e.prefix FROM (SELECT DISTINCT substr(elem, 1, 8) AS prefix FROM edges) e
           JOIN pages_ p ON starts_with(p.page_id, e.prefix)""",
        extra=NODES,
    ),
)
def _(spark, sf):
    t = tables(spark, sf)
    prefixes = t["edges"].select(F.substring("elem", 1, 8).alias("prefix"))
    return G.prefix_match(t["pages"], "page_id", prefixes, 8).select("page_id", "prefix")


@query(
    "F13_point_lookups",
    with_ctes(
        "edges",
        """SELECT element_id, function_summary, goal FROM elements_
           WHERE element_id = (SELECT max(elem) FROM edges)""",
        extra=NODES,
    ),
)
def _(spark, sf):
    t = tables(spark, sf)
    wanted = t["edges"].agg(F.max("elem").alias("element_id"))
    return t["elements"].join(wanted, "element_id", "left_semi")


@query(
    "S07_graph_write",
    with_ctes(
        "edges",
        """SELECT 'page' AS kind, page_id AS id, function_summary AS value, string_split(page_id, '_')[1] AS app FROM pages_
           UNION ALL SELECT 'has_element', page_id, element_id, string_split(page_id, '_')[1] FROM has_element""",
        extra=NODES,
    ),
)
def _(spark, sf):
    t = tables(spark, sf)
    app = F.get(F.split("page_id", "_"), F.lit(0))
    folder = scratch(spark, "graph-export")
    parts = {"pages": t["pages"].select("page_id", "function_summary"), "has_element": t["has_element"]}
    write_graph({name: rows.withColumn("app", app) for name, rows in parts.items()}, folder)
    read = lambda name, value: spark.read.parquet(f"{folder}/{name}").select(
        F.lit(name).alias("kind"), F.col("page_id").alias("id"), F.col(value).alias("value"), "app"
    )
    pages = read("pages", "function_summary").withColumn("kind", F.lit("page"))
    return pages.unionByName(read("has_element", "element_id"))


@query(
    "J01_graph_neighbourhood",
    with_ctes(
        "edges",
        """SELECT p.page_id, h.element_id, l.page_id AS target FROM pages_ p
           LEFT JOIN has_element h ON h.page_id = p.page_id
           LEFT JOIN leads_to l ON l.element_id = h.element_id""",
        extra=NODES,
    ),
)
def _(spark, sf):
    t = tables(spark, sf)
    return G.neighbourhood(t["pages"], t["has_element"], t["leads_to"])


@query(
    "J02_page_elements",
    with_ctes(
        "edges",
        """SELECT h.page_id, e.element_id, e.function_summary FROM has_element h
           JOIN elements_ e ON e.element_id = h.element_id WHERE e.function_summary IS NOT NULL""",
        extra=NODES,
    ),
)
def _(spark, sf):
    t = tables(spark, sf)
    # Element properties arrive as stored JSON; only described elements stay.
    stored = t["elements"].select("element_id", F.to_json(F.struct("function_summary")).alias("reasoning"))
    return (
        t["has_element"].join(stored, "element_id")
        .select("page_id", "element_id", F.get_json_object("reasoning", "$.function_summary").alias("function_summary"))
        .filter(F.col("function_summary").isNotNull())
    )


@query(
    "J03_action_sequence",
    with_ctes(
        "edges",
        """SELECT c.action_id, c."order", c.element_id, e.function_summary
           FROM composed c JOIN elements_ e ON e.element_id = c.element_id""",
        extra=NODES + "," + COMPOSITES,
    ),
)
def _(spark, sf):
    return G.action_sequence(G.composed_of(composites(spark, sf)), tables(spark, sf)["elements"])


@query(
    "J05_alternate_targets",
    with_ctes(
        "tokens",
        """SELECT DISTINCT l.chain_id, l.src, l.elem, l.tgt, e.tgt AS other
           FROM (SELECT chain_id, arg_max(src, pos) AS src, arg_max(elem, pos) AS elem, arg_max(tgt, pos) AS tgt
                 FROM tokens GROUP BY chain_id) l
           JOIN (SELECT DISTINCT src, elem, tgt FROM tokens) e ON e.src = l.src AND e.elem = l.elem
           WHERE e.tgt <> l.tgt""",
    ),
)
def _(spark, sf):
    t = A.tokens(spark, sf)
    last = t.groupBy("chain_id").agg(F.max_by(F.struct("src", "elem", "tgt"), "pos").alias("s")).select(
        "chain_id", "s.*"
    )
    return G.alternate_targets(t, last).select("chain_id", "src", "elem", "tgt", "other")


@query(
    "S07_graph_export_pages",
    with_ctes(
        "edges",
        """SELECT h.page_id, c.action_id FROM has_element h
           JOIN composed c ON c.element_id = h.element_id AND c."order" = 0 GROUP BY ALL""",
        extra=NODES + "," + COMPOSITES,
    ),
)
def _(spark, sf):
    return G.page_action_ids(tables(spark, sf)["has_element"], G.composed_of(composites(spark, sf)))


@query(
    "S07_graph_export_actions",
    with_ctes(
        "edges",
        """SELECT c.action_id, l.page_id FROM composed c
           JOIN leads_to l ON l.element_id = c.element_id WHERE c."order" = 1 GROUP BY ALL""",
        extra=NODES + "," + COMPOSITES,
    ),
)
def _(spark, sf):
    return G.action_targets(G.composed_of(composites(spark, sf)), tables(spark, sf)["leads_to"])


@query(
    "J15_same_element_match",
    with_ctes(
        "steps",
        """SELECT probe_id, best.element_id AS element_id, best.rule AS rule FROM (
             SELECT probe_id, min({'rule': rule, 'element_id': element_id}) AS best FROM (
               SELECT p.probe_id, s.element_id, 1 AS rule FROM probes p JOIN stored s
                 ON s.page_id = p.page_id AND s.uid = p.uid AND s.action = p.action
               UNION ALL
               SELECT p.probe_id, s.element_id, 2 FROM probes p JOIN stored s
                 ON s.page_id = p.page_id AND s.ui_id = p.ui_id AND s.bbox = p.bbox) GROUP BY probe_id)""",
        extra="""
stored AS (
  SELECT page AS page_id, min(event_id) AS element_id, CAST(user_id AS VARCHAR) AS uid, control AS ui_id,
         CAST(k // 10 AS VARCHAR) AS bbox, event_type AS action
  FROM (SELECT s.*, e.user_id FROM steps s JOIN events e ON e.event_id = s.event_id) WHERE step = 0
  GROUP BY ALL),
probes AS (
  SELECT s.event_id AS probe_id, page AS page_id, CAST(e.user_id AS VARCHAR) AS uid, control AS ui_id,
         CAST(k // 10 AS VARCHAR) AS bbox, s.event_type AS action
  FROM steps s JOIN events e ON e.event_id = s.event_id WHERE step > 0)""",
    ),
)
def _(spark, sf):
    s = A.steps(spark, sf).select(
        "event_id", "step", F.col("page").alias("page_id"), F.substring("task", 2, 20).alias("uid"),
        F.col("control").alias("ui_id"), F.floor(F.col("k") / 10).cast("string").alias("bbox"),
        F.col("event_type").alias("action"),
        F.col("event_type").alias("action_type"), F.lit(None).cast("string").alias("action_arg"),
        F.col("next_page").alias("target"),
    )
    stored = (
        s.filter("step = 0")
        .groupBy("page_id", "uid", "ui_id", "bbox", "action", "action_type", "action_arg")
        .agg(F.min("event_id").alias("element_id"))
        .withColumn("target", F.lit(None).cast("string"))
    )
    probes = s.filter("step > 0").select(
        F.col("event_id").alias("probe_id"), "page_id", "uid", "ui_id", "bbox", "action", "action_type", "action_arg"
    )
    return G.same_element(stored, probes).select("probe_id", "element_id", "rule")


@query(
    "J18_ordered_lookup",
    with_ctes(
        "edges",
        """SELECT elem AS list_id, pos, page_id, raw_page FROM (
             SELECT DISTINCT elem, unnest([0, 1]) AS pos, unnest([src, tgt]) AS page_id FROM edges)
           LEFT JOIN (SELECT page_id AS pid, function_summary AS raw_page FROM pages_
                      WHERE function_summary <> '') ON pid = page_id""",
        extra=NODES,
    ),
)
def _(spark, sf):
    t = tables(spark, sf)
    ids = t["edges"].select(F.col("elem").alias("list_id"), F.array("src", "tgt").alias("ids")).distinct()
    payload = t["pages"].filter("function_summary <> ''").select("page_id", F.col("function_summary").alias("raw_page"))
    return G.ordered_lookup(ids, payload)


@query(
    "J19_plan_action_ref",
    with_ctes(
        "steps",
        """SELECT event_id, CASE WHEN k % 2 = 0 THEN 'element' ELSE lower(event_type) END AS type,
                  CASE WHEN k % 2 = 0 THEN lower(to_hex(k)) ELSE page END AS id FROM steps""",
    ),
)
def _(spark, sf):
    step = F.when(
        F.col("k") % 2 == 0,
        F.concat(F.lit("tap it_$Element_"), F.lower(F.hex(F.col("k"))), F.lit("$")),
    ).otherwise(F.col("page"))
    ref = G.plan_reference(step, F.col("event_type"), F.col("page"))
    return A.steps(spark, sf).select("event_id", ref.alias("r")).select("event_id", "r.type", "r.id")

"""Mining and path queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mining, paths
from ..operators.gold import gold_paths
from ..operators.graph import alternate_targets
from ..plans import adapters as A
from ..plans.adapters import with_ctes
from ..plans.checkpoints import kept
from ..plans.ordered import lead, ordered_columns
from .graph import NODES, tables
from .registry import query

# --------------------------------------------------------------- mining (P04-P08)


@query(
    "P04_atomic_action_freq",
    with_ctes("tokens", "SELECT src, elem, tgt, count(*) AS frequency FROM tokens GROUP BY ALL"),
)
def _(spark, sf):
    return mining.atomic_frequencies(A.tokens(spark, sf))


PAIRS = """
pairs AS (
  SELECT chain_id, pos, src || '|' || elem || '|' || tgt AS token,
         lead(src || '|' || elem || '|' || tgt) OVER w AS next_token,
         src || '|' || elem || '|' || tgt || ';' || lead(src || '|' || elem || '|*') OVER w
           AS pair_key
  FROM tokens WINDOW w AS (PARTITION BY chain_id ORDER BY pos))"""


@query(
    "P05_action_pair_freq",
    with_ctes(
        "tokens",
        """SELECT pair_key, count(*) AS frequency,
                  arg_min(token, (chain_id, pos)) AS first_token,
                  arg_min(next_token, (chain_id, pos)) AS second_token
           FROM pairs WHERE pair_key IS NOT NULL GROUP BY pair_key""",
        extra=PAIRS,
    ),
)
def _(spark, sf):
    return mining.pair_frequencies(A.tokens(spark, sf))


@query(
    "P07_merge_pair",
    with_ctes(
        "tokens",
        """SELECT chain_id, pos, CASE WHEN taken THEN 'M0' ELSE token END AS token
           FROM (SELECT *, lag(taken) OVER (PARTITION BY chain_id ORDER BY pos) AS after_taken
                 FROM taken)
           WHERE NOT coalesce(after_taken, FALSE)""",
        extra=PAIRS
        + """,
top AS (
  SELECT pair_key FROM pairs WHERE pair_key IS NOT NULL GROUP BY pair_key
  ORDER BY count(*) DESC, min((chain_id, pos)) LIMIT 1),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY pos) AS idx,
         coalesce(pair_key = (SELECT pair_key FROM top), FALSE) AS hit
  FROM pairs),
runs AS (
  SELECT *, max(CASE WHEN hit THEN 0 ELSE idx END)
    OVER (PARTITION BY chain_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS miss FROM marked),
taken AS (SELECT *, hit AND (idx - miss) % 2 = 1 AS taken FROM runs)""",
    ),
)
def _(spark, sf):
    return mining.merge_top_pair(A.tokens(spark, sf)).select("chain_id", "pos", "token")


# One round of mining after the other, unrolled: pairs, best key, marks from the left, rewritten rows.
MERGES = 20
MINE_START = """
t0 AS MATERIALIZED (
  SELECT chain_id, pos, src || '|' || elem || '|' || tgt AS token, src || '|' || elem || '|' || tgt AS parts, 1 AS level FROM tokens),
first_id AS (SELECT count(DISTINCT token) AS n FROM t0)"""
MINE_ROUND = """
p{r} AS MATERIALIZED (
  SELECT *, parts || ';' || regexp_replace(next_parts, '\\|[^|]*$', '|*') AS pair_key FROM (
    SELECT *, lead(token) OVER w AS next_token, lead(parts) OVER w AS next_parts, lead(level) OVER w AS next_level,
           row_number() OVER w AS idx FROM t{q} WINDOW w AS (PARTITION BY chain_id ORDER BY pos))),
b{r} AS MATERIALIZED (
  SELECT pair_key, count(*) AS n, arg_min({{'a': token, 'b': next_token, 'parts': parts || ';' || next_parts,
           'level': greatest(level, next_level) + 1}}, (chain_id, pos)) AS won
  FROM p{r} WHERE pair_key IS NOT NULL GROUP BY pair_key HAVING count(*) >= 2 ORDER BY n DESC, min((chain_id, pos)) LIMIT 1),
t{r} AS MATERIALIZED (
  SELECT chain_id, pos, CASE WHEN taken THEN 'M' || ((SELECT n FROM first_id) + {q}) ELSE token END AS token,
         CASE WHEN taken THEN (SELECT won.parts FROM b{r}) ELSE parts END AS parts,
         CASE WHEN taken THEN (SELECT won.level FROM b{r}) ELSE level END AS level
  FROM (SELECT *, lag(taken) OVER (PARTITION BY chain_id ORDER BY pos) AS after_taken FROM (
    SELECT *, hit AND (idx - max(CASE WHEN hit THEN 0 ELSE idx END) OVER (PARTITION BY chain_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) % 2 = 1 AS taken
    FROM (SELECT *, coalesce(pair_key = (SELECT pair_key FROM b{r}), FALSE) AS hit FROM p{r})))
  WHERE NOT coalesce(after_taken, FALSE))"""
MINE = (
    MINE_START
    + "".join("," + MINE_ROUND.format(r=r, q=r - 1) for r in range(1, MERGES + 1))
    + ",\nmerges AS ("
    + " UNION ALL ".join(
        f"""SELECT {r} AS merge_order, 'M' || ((SELECT n FROM first_id) + {r - 1}) AS merged_id, won.a AS first_token, won.b AS second_token,
           n AS frequency, won.level AS level, won.parts AS components FROM b{r}"""
        for r in range(1, MERGES + 1)
    )
    + ")"
)


@query("P06_bpe_mine", with_ctes("tokens", "SELECT * FROM merges", extra=MINE))
def _(spark, sf):
    merges, _ = mining.mine_sequences(A.tokens(spark, sf), num_merges=MERGES, min_freq=2)
    return merges.select(
        "merge_order", "merged_id", "first_token", "second_token", "frequency", "level",
        F.array_join("components", ";").alias("components"),
    )


@query(
    "P06_mined_chains",
    with_ctes("tokens", f"SELECT chain_id, pos, token FROM t{MERGES}", extra=MINE),
)
def _(spark, sf):
    _, chains = mining.mine_sequences(A.tokens(spark, sf), num_merges=MERGES, min_freq=2)
    return chains.select("chain_id", "pos", "token")


@query(
    "P08_rank_composites",
    with_ctes(
        "tokens",
        """SELECT 'HighLevelAction_' || row_number() OVER (ORDER BY frequency DESC, level DESC, merge_order) AS name, merged_id AS id, frequency, level,
                  len(string_split(components, ';')) AS num_components,
                  array_to_string([
                    '(' || array_to_string([substr(x, 1, 8) || '...' FOR x IN string_split(c, '|')], ', ') || ')'
                    FOR c IN string_split(components, ';')], ';') AS components_preview
           FROM merges WHERE level >= 2""",
        extra=MINE,
    ),
)
def _(spark, sf):
    merges, _ = mining.mine_sequences(A.tokens(spark, sf), num_merges=MERGES, min_freq=2)
    return mining.rank_composites(merges).withColumn(
        "components_preview", F.array_join("components_preview", ";")
    )


# ------------------------------------------------------- task-step paths (P01 …)


def graph_tables(spark, sf):
    e = A.shared_edges(spark, sf)
    page_steps = (
        e.select(F.col("src").alias("page_id"), "task", "step")
        .unionByName(e.select(F.col("tgt").alias("page_id"), "task", (F.col("step") + 1).alias("step")))
        .distinct()
    )
    return {
        "edges": e,
        "has_element": e.select(F.col("src").alias("page_id"), F.col("elem").alias("element_id")).distinct(),
        "leads_to": e.select(F.col("elem").alias("element_id"), F.col("tgt").alias("page_id")).distinct(),
        "page_steps": page_steps,
        "element_steps": e.select(F.col("elem").alias("element_id"), "task", "step").distinct(),
        "pages": page_steps.select("page_id").distinct(),
    }


GRAPH = """
page_steps AS (
  SELECT src AS page_id, task, step FROM edges
  UNION SELECT tgt, task, step + 1 FROM edges),
has_element AS (SELECT DISTINCT src AS page_id, elem AS element_id FROM edges),
leads_to AS (SELECT DISTINCT elem AS element_id, tgt AS page_id FROM edges),
element_steps AS (SELECT DISTINCT elem AS element_id, task, step FROM edges),
task_edges AS (
  SELECT DISTINCT es.task, es.step, h.page_id AS src, es.element_id AS elem, l.page_id AS tgt
  FROM element_steps es
  JOIN has_element h ON h.element_id = es.element_id
  JOIN leads_to l ON l.element_id = es.element_id
  WHERE EXISTS (SELECT 1 FROM page_steps p
                WHERE p.page_id = h.page_id AND p.task = es.task AND p.step = es.step)
    AND EXISTS (SELECT 1 FROM page_steps p
                WHERE p.page_id = l.page_id AND p.task = es.task AND p.step = es.step + 1))"""

WALK = GRAPH + """,
walk AS (
  SELECT task, page_id AS start_page, page_id AS page, CAST(0 AS BIGINT) AS step,
         'P:' || page_id AS path_id, CAST(0 AS BIGINT) AS n_steps
  FROM page_steps WHERE step = 0
  UNION ALL
  SELECT w.task, w.start_page, e.tgt, w.step + 1,
         w.path_id || '->E:' || e.elem || '->P:' || e.tgt, w.n_steps + 1
  FROM walk w JOIN task_edges e ON e.task = w.task AND e.step = w.step AND e.src = w.page),
paths AS (
  SELECT DISTINCT task, start_page, page AS leaf_page, path_id, n_steps FROM walk w
  WHERE n_steps > 0 AND NOT EXISTS (
    SELECT 1 FROM task_edges e WHERE e.task = w.task AND e.step = w.step AND e.src = w.page))"""


def _task_edges(g):
    return paths.task_step_edges(g["has_element"], g["leads_to"], g["page_steps"], g["element_steps"])


def _task_paths(spark, sf):
    g = graph_tables(spark, sf)
    starts = g["page_steps"].filter(F.col("step") == 0).select("task", "page_id", "step")
    return paths.task_paths(starts, _task_edges(g))


@query(
    "P01_task_paths",
    with_ctes(
        "edges", "SELECT task, start_page, leaf_page, path_id, n_steps FROM paths",
        recursive=True, extra=WALK,
    ),
)
def _(spark, sf):
    return _task_paths(spark, sf).select(
        "task", "start_page", "leaf_page", "path_id", F.size("triplets").cast("long").alias("n_steps")
    )


@query(
    "P01_task_step_edges",
    with_ctes("edges", "SELECT task, step, src, elem, tgt FROM task_edges", extra=GRAPH),
)
def _(spark, sf):
    return _task_edges(graph_tables(spark, sf))


CHAINS = """
g AS (SELECT DISTINCT task AS graph, src, elem, tgt FROM edges),
roots AS (
  SELECT DISTINCT graph, src AS page_id FROM g
  WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.graph = g.graph AND h.tgt = g.src)),
walk AS (
  SELECT graph, page_id AS start_page, page_id AS page, 'P:' || page_id AS path_id,
         [page_id] AS visited, CAST(0 AS BIGINT) AS n_steps FROM roots
  UNION ALL
  SELECT w.graph, w.start_page, g.tgt, w.path_id || '->E:' || g.elem || '->P:' || g.tgt,
         list_append(w.visited, g.tgt), w.n_steps + 1
  FROM walk w JOIN g ON g.graph = w.graph AND g.src = w.page
  WHERE NOT list_contains(w.visited, g.tgt)),
chains AS (
  SELECT graph, start_page, page AS leaf_page, path_id, n_steps FROM walk w
  WHERE n_steps > 0 AND NOT EXISTS (SELECT 1 FROM g WHERE g.graph = w.graph AND g.src = w.page))"""


def _chains(spark, sf):
    g = A.edges(spark, sf).select(F.col("task").alias("graph"), "src", "elem", "tgt").distinct()
    roots = (
        g.select("graph", F.col("src").alias("page_id"))
        .distinct()
        .join(g.select("graph", F.col("tgt").alias("page_id")), ["graph", "page_id"], "left_anti")
    )
    return paths.all_chains(roots, g).withColumn("n_steps", F.col("n_steps").cast("long"))


@query(
    "P02_all_chains",
    with_ctes("edges", "SELECT * FROM chains", recursive=True, extra=CHAINS),
)
def _(spark, sf):
    return _chains(spark, sf)


@query(
    "P03_start_chains",
    with_ctes(
        "edges",
        """SELECT graph, start_page, min(path_id) AS path_id, arg_min(n_steps, path_id) AS n_steps,
                  arg_min(leaf_page, path_id) AS leaf_page
           FROM chains GROUP BY graph, start_page""",
        recursive=True,
        extra=CHAINS,
    ),
)
def _(spark, sf):
    return paths.first_chains(_chains(spark, sf))


@query(
    "P22_chain_ids",
    with_ctes(
        "edges", "SELECT graph, start_page, path_id FROM chains", recursive=True, extra=CHAINS
    ),
)
def _(spark, sf):
    return _chains(spark, sf).select("graph", "start_page", "path_id")


@query(
    "P18_forced_chain",
    with_ctes(
        "edges",
        """SELECT graph, start_page, page AS end_page, forced FROM walk w
           WHERE n_steps = 10 OR NOT EXISTS (
             SELECT 1 FROM only_step o WHERE o.graph = w.graph AND o.src = w.page
               AND NOT list_contains(w.visited, o.tgt))""",
        recursive=True,
        extra="""
only_step AS (
  SELECT task AS graph, src, min(elem) AS elem, arg_min(tgt, elem) AS tgt
  FROM edges GROUP BY task, src HAVING count(DISTINCT elem) = 1),
walk AS (
  SELECT graph, src AS start_page, tgt AS page, elem AS forced, [src, tgt] AS visited, 1 AS n_steps
  FROM only_step WHERE src <> tgt
  UNION ALL
  SELECT w.graph, w.start_page, o.tgt, w.forced || ' ' || o.elem, list_append(w.visited, o.tgt),
         w.n_steps + 1
  FROM walk w JOIN only_step o ON o.graph = w.graph AND o.src = w.page
  WHERE w.n_steps < 10 AND NOT list_contains(w.visited, o.tgt))""",
    ),
)
def _(spark, sf):
    g = A.edges(spark, sf).select(F.col("task").alias("graph"), "src", "elem", "tgt")
    return paths.forced_chains(g).withColumn("forced", F.array_join("forced", " "))


# Two steps in a row from pages of one kind are a composite action of the first page.
COMPOSITES = """
twice AS (
  SELECT task AS graph, src, split_part(src, '_', 1) AS kind, split_part(tgt, '_', 1) AS mid_kind, lead(tgt) OVER w AS tgt
  FROM edges WINDOW w AS (PARTITION BY task, branch ORDER BY step)),
composites AS (SELECT graph, src, 'A:' || kind || '+' || tgt AS action, tgt FROM twice WHERE tgt IS NOT NULL AND kind = mid_kind)"""


def composites(edges):
    """``graph, src, action, tgt`` of the composite actions, a row for each time one was taken."""
    kind = lambda c: F.split_part(c, F.lit("_"), F.lit(1))
    twice = ordered_columns(
        edges.select("task", "branch", "step", "src", F.col("tgt").alias("mid")), ["task", "branch"], ["step"], [lead("tgt", "mid")], hot=False
    )
    return twice.filter(F.col("tgt").isNotNull() & (kind(F.col("src")) == kind(F.col("mid")))).select(
        F.col("task").alias("graph"), "src", F.concat(F.lit("A:"), kind(F.col("src")), F.lit("+"), "tgt").alias("action"), "tgt"
    )


@query(
    "P18_forced_chain_actions",
    with_ctes(
        "edges",
        """SELECT graph, start_page, page AS end_page, forced FROM walk w
           WHERE n_steps = 10 OR NOT EXISTS (
             SELECT 1 FROM only_step o WHERE o.graph = w.graph AND o.src = w.page AND NOT list_contains(w.visited, o.tgt))""",
        recursive=True,
        extra=COMPOSITES + """,
both_kinds AS (SELECT task AS graph, src, elem AS move, tgt FROM edges UNION ALL SELECT graph, src, action, tgt FROM composites),
only_step AS (
  SELECT graph, src, min(move) AS move, min(tgt) AS tgt FROM both_kinds GROUP BY graph, src HAVING count(DISTINCT move) = 1),
walk AS (
  SELECT graph, src AS start_page, tgt AS page, move AS forced, [src, tgt] AS visited, 1 AS n_steps FROM only_step WHERE src <> tgt
  UNION ALL
  SELECT w.graph, w.start_page, o.tgt, w.forced || ' ' || o.move, list_append(w.visited, o.tgt), w.n_steps + 1
  FROM walk w JOIN only_step o ON o.graph = w.graph AND o.src = w.page WHERE w.n_steps < 10 AND NOT list_contains(w.visited, o.tgt))""",
    ),
)
def _(spark, sf):
    e = A.edges(spark, sf)
    g = e.select(F.col("task").alias("graph"), "src", "elem", "tgt")
    return paths.forced_chains(g, composites(e)).withColumn("forced", F.array_join("forced", " "))


# ------------------------------------------------------------ P09, P10 rewriting

GROUPS = """
path_steps AS (
  SELECT chain_id AS path_id, pos, src, elem, tgt FROM tokens),
nxt AS (
  SELECT path_id, elem, lead(elem) OVER (PARTITION BY path_id ORDER BY pos) AS elem2 FROM path_steps),
freq AS (
  SELECT elem AS a, elem2 AS b, count(*) AS n FROM nxt
  WHERE elem2 IS NOT NULL AND elem <> elem2 GROUP BY ALL),
actions AS (
  SELECT 'A:' || a || '+' || b AS action_id, a, b FROM freq WHERE n * 400 > (SELECT sum(n) FROM freq)),
action_elements AS (
  SELECT action_id, a AS element_id FROM actions UNION ALL SELECT action_id, b FROM actions),
matches AS (
  SELECT p.path_id, e.action_id, count(*) AS group_size
  FROM (SELECT DISTINCT path_id, elem FROM path_steps) p
  JOIN action_elements e ON e.element_id = p.elem GROUP BY ALL HAVING count(*) = 2)"""


def _groups(spark, sf):
    steps = A.tokens(spark, sf).select(F.col("chain_id").alias("path_id"), "pos", "src", "elem", "tgt")
    return steps, _members(steps)


def _members(steps):
    """Composite actions: pairs of neighbours that make up one in 400 of all pairs."""
    nxt = ordered_columns(steps, ["path_id"], ["pos"], [lead("elem2", "elem")])
    freq = (
        nxt.filter(F.col("elem2").isNotNull() & (F.col("elem") != F.col("elem2")))
        .groupBy(F.col("elem").alias("a"), F.col("elem2").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = freq.agg(F.sum("n").alias("total"))
    return (
        freq.join(F.broadcast(total))
        .filter(F.col("n") * 400 > F.col("total"))
        .select(
            F.concat(F.lit("A:"), "a", F.lit("+"), "b").alias("action_id"),
            F.explode(F.array("a", "b")).alias("element_id"),
        )
    )


@query(
    "P09_matching_groups",
    with_ctes("tokens", "SELECT path_id, action_id, group_size FROM matches", extra=GROUPS),
)
def _(spark, sf):
    steps, members = _groups(spark, sf)
    return paths.matching_groups(
        steps.select("path_id", F.col("elem").alias("element_id")), members
    )


# The greedy choice is sequential, so the check walks the sorted candidates recursively.
REWRITE = GROUPS + """,
cand AS (
  SELECT m.path_id, m.action_id, a.a, a.b,
         row_number() OVER (PARTITION BY m.path_id ORDER BY m.action_id) AS i
  FROM matches m JOIN actions a ON a.action_id = m.action_id),
pick AS (
  SELECT path_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, CAST([] AS VARCHAR[]) AS picked
  FROM (SELECT DISTINCT path_id FROM cand)
  UNION ALL
  SELECT p.path_id, p.i + 1,
         CASE WHEN list_contains(p.used, c.a) OR list_contains(p.used, c.b) THEN p.used
              ELSE list_concat(p.used, [c.a, c.b]) END,
         CASE WHEN list_contains(p.used, c.a) OR list_contains(p.used, c.b) THEN p.picked
              ELSE list_append(p.picked, c.action_id) END
  FROM pick p JOIN cand c ON c.path_id = p.path_id AND c.i = p.i + 1),
last_pick AS (SELECT path_id, arg_max(picked, i) AS picked FROM pick GROUP BY path_id),
chosen AS (
  SELECT l.path_id, e.action_id, e.element_id
  FROM (SELECT path_id, unnest(picked) AS action_id FROM last_pick) l
  JOIN action_elements e ON e.action_id = l.action_id),
marked AS (
  SELECT s.*, c.action_id, lag(c.action_id) OVER (PARTITION BY s.path_id ORDER BY s.pos) AS prev_action
  FROM path_steps s LEFT JOIN chosen c ON c.path_id = s.path_id AND c.element_id = s.elem),
islands AS (
  SELECT *, sum(CASE WHEN action_id = prev_action THEN 0 ELSE 1 END)
    OVER (PARTITION BY path_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM marked)"""


@query(
    "P10_action_group_rewrite",
    with_ctes(
        "tokens",
        """SELECT path_id, CAST(run AS BIGINT) AS run, arg_min(src, pos) AS src,
                  arg_min(coalesce(action_id, elem), pos) AS elem, arg_max(tgt, pos) AS tgt,
                  bool_or(action_id IS NOT NULL) AS is_group, count(*) AS n_steps
           FROM islands GROUP BY path_id, run""",
        recursive=True,
        extra=REWRITE,
    ),
)
def _(spark, sf):
    steps, members = _groups(spark, sf)
    matches = paths.matching_groups(steps.select("path_id", F.col("elem").alias("element_id")), members)
    chosen = paths.choose_groups(matches, members)
    return paths.rewrite_with_groups(steps, chosen)


# ------------------------------------------------- rendering and gold paths (P11 …)


def _path_steps(spark, sf):
    """Steps of every task path, long form."""
    return _task_paths(spark, sf).select(
        "task", F.col("path_id"), F.posexplode("triplets").alias("pos", "t")
    ).select("task", F.concat_ws("#", "task", "path_id").alias("path_id"), "pos", "t.src", "t.elem", "t.tgt")


PATH_STEPS = WALK.replace(
    "'P:' || page_id AS path_id, CAST(0 AS BIGINT) AS n_steps",
    "'P:' || page_id AS path_id, CAST(0 AS BIGINT) AS n_steps, CAST([] AS STRUCT(src VARCHAR, elem VARCHAR, tgt VARCHAR)[]) AS triplets",
).replace(
    "w.n_steps + 1\n",
    "w.n_steps + 1, list_append(w.triplets, {'src': w.page, 'elem': e.elem, 'tgt': e.tgt})\n",
).replace("path_id, n_steps FROM walk w", "path_id, n_steps, triplets FROM walk w") + """,
path_rows AS (
  SELECT task, task || '#' || path_id AS path_id, pos - 1 AS pos, t.src AS src, t.elem AS elem, t.tgt AS tgt
  FROM (SELECT task, path_id, unnest(triplets) AS t, unnest(range(1, len(triplets) + 1)) AS pos FROM paths)),
pages_ AS (
  SELECT page_id,
         CASE WHEN page_id LIKE 'signup%' THEN NULL WHEN page_id LIKE 'error%' THEN ''
              ELSE 'Screen ' || page_id END AS function_summary,
         CASE WHEN page_id LIKE 'purchase%' THEN 'buy at ' || page_id ELSE '' END AS goal
  FROM (SELECT DISTINCT page_id FROM page_steps)),
elements_ AS (
  SELECT element_id, CASE WHEN tgt NOT LIKE 'view%' THEN 'go to ' || tgt END AS function_summary,
         CASE WHEN tgt LIKE 'click%' THEN 'open ' || tgt ELSE '' END AS goal
  FROM (SELECT DISTINCT elem AS element_id, tgt FROM edges)),
enriched AS (
  SELECT r.*, s.function_summary AS src_summary, e.function_summary AS elem_summary,
         t.function_summary AS tgt_summary, s.goal AS src_goal, e.goal AS elem_goal, t.goal AS tgt_goal
  FROM path_rows r LEFT JOIN pages_ s ON s.page_id = r.src
  LEFT JOIN elements_ e ON e.element_id = r.elem LEFT JOIN pages_ t ON t.page_id = r.tgt)"""


def _enriched(spark, sf):
    t = tables(spark, sf)
    return paths.enrich_steps(_path_steps(spark, sf), t["pages"], t["elements"])


@query(
    "J04_enrich_paths",
    with_ctes(
        "edges",
        "SELECT path_id, pos, src_summary, elem_summary, tgt_summary FROM enriched",
        recursive=True, extra=PATH_STEPS,
    ),
)
def _(spark, sf):
    return _enriched(spark, sf).select("path_id", F.col("pos").cast("long").alias("pos"), "src_summary", "elem_summary", "tgt_summary")


SIMPLIFIED = """
       coalesce(src_summary, 'Unknown source') || '_$' || src || '$' AS source_page,
       coalesce(elem_summary, 'Unknown element') || '_$Element_' || elem || '$' AS element,
       coalesce(tgt_summary, 'Unknown source') || '_$' || tgt || '$' AS target_page"""


@query(
    "P12_simplify",
    with_ctes(
        "edges", "SELECT path_id, pos, " + SIMPLIFIED + " FROM enriched", recursive=True, extra=PATH_STEPS
    ),
)
def _(spark, sf):
    out = paths.simplified()
    return _enriched(spark, sf).select(
        "path_id", F.col("pos").cast("long").alias("pos"), *[c.alias(n) for n, c in out.items()]
    )


@query(
    "P13_extract_goal",
    with_ctes(
        "edges",
        """SELECT path_id, coalesce(arg_min(
                    coalesce(nullif(src_goal, ''), nullif(elem_goal, ''), nullif(tgt_goal, '')), pos)
                    FILTER (WHERE coalesce(src_goal, '') || coalesce(elem_goal, '') || coalesce(tgt_goal, '') <> ''),
                  '') AS goal
           FROM enriched GROUP BY path_id""",
        recursive=True, extra=PATH_STEPS,
    ),
)
def _(spark, sf):
    return paths.first_goal(_enriched(spark, sf))


@query(
    "P11_gold_paths",
    with_ctes(
        "edges",
        """SELECT task, path_id, any_value(g) AS goal, string_agg(source_page || ' ' || element || ' ' || target_page,
                  ' | ' ORDER BY pos) AS path, count(*) AS n_steps
           FROM (SELECT *, coalesce(arg_min(coalesce(nullif(src_goal, ''), nullif(elem_goal, ''), nullif(tgt_goal, '')), pos)
                   FILTER (WHERE coalesce(src_goal, '') || coalesce(elem_goal, '') || coalesce(tgt_goal, '') <> '')
                   OVER (PARTITION BY path_id), '') AS g, """ + SIMPLIFIED + """ FROM enriched)
           GROUP BY task, path_id""",
        recursive=True, extra=PATH_STEPS,
    ),
)
def _(spark, sf):
    return gold_paths(_enriched(spark, sf)).select(
        "task", "path_id", "goal", F.array_join(F.transform("path", lambda s: F.array_join(s, " ")), " | ").alias("path"),
        F.size("path").cast("long").alias("n_steps"),
    )


# The same rewriting over all task paths.
PATH_REWRITE = PATH_STEPS + "," + REWRITE.replace(
    "SELECT chain_id AS path_id, pos, src, elem, tgt FROM tokens", "SELECT path_id, pos, src, elem, tgt FROM path_rows"
) + """,
rewritten AS (
  SELECT path_id, CAST(run AS BIGINT) AS run, arg_min(src, pos) AS src, arg_min(coalesce(action_id, elem), pos) AS elem,
         arg_max(tgt, pos) AS tgt, bool_or(action_id IS NOT NULL) AS is_group, count(*) AS n_steps
  FROM islands GROUP BY path_id, run)"""


def _rewritten(spark, sf):
    steps = kept(_path_steps(spark, sf), "path-steps")
    members = _members(steps)
    matches = paths.matching_groups(steps.select("path_id", F.col("elem").alias("element_id")), members)
    return steps, paths.rewrite_with_groups(steps.drop("task"), paths.choose_groups(matches, members))


@query(
    "P11b_all_task_paths_rewritten",
    with_ctes("edges", "SELECT path_id, run, src, elem, tgt, is_group, n_steps FROM rewritten", recursive=True, extra=PATH_REWRITE),
)
def _(spark, sf):
    return _rewritten(spark, sf)[1]


@query(
    "P11_gold_paths_rewritten",
    with_ctes(
        "edges",
        """SELECT r.path_id, count(*) AS n_steps, count(*) FILTER (is_group) AS n_actions,
                  string_agg(coalesce(s.function_summary, 'Unknown source') || '_$' || src || '$ '
                    || coalesce(e.function_summary, 'Unknown element') || CASE WHEN is_group THEN '_$Action_' ELSE '_$Element_' END || elem || '$ '
                    || coalesce(t.function_summary, 'Unknown source') || '_$' || r.tgt || '$', ' | ' ORDER BY run) AS path
           FROM rewritten r LEFT JOIN pages_ s ON s.page_id = r.src LEFT JOIN elements_ e ON e.element_id = r.elem
           LEFT JOIN pages_ t ON t.page_id = r.tgt GROUP BY r.path_id""",
        recursive=True, extra=PATH_REWRITE,
    ),
)
def _(spark, sf):
    t = tables(spark, sf)
    steps, rewritten = _rewritten(spark, sf)
    tasks = steps.select("task", "path_id").distinct()
    enriched = paths.enrich_steps(rewritten.withColumnRenamed("run", "pos").join(tasks, "path_id"), t["pages"], t["elements"])
    out = gold_paths(enriched, is_group=F.col("is_group"))
    is_action = lambda s: F.contains(F.element_at(s, 2), F.lit("_$Action_"))
    return out.select(
        "path_id", F.size("path").cast("long").alias("n_steps"), F.size(F.filter("path", is_action)).cast("long").alias("n_actions"),
        F.array_join(F.transform("path", lambda s: F.array_join(s, " ")), " | ").alias("path"),
    )


@query(
    "P14_parse_path_tokens",
    with_ctes(
        "edges",
        """SELECT path_id, pos, 'element' AS type, src AS start_page,
                  md5(elem) AS id FROM path_rows""",
        recursive=True, extra=PATH_STEPS,
    ),
)
def _(spark, sf):
    text = F.concat(F.lit("tap_$Element_"), F.md5("elem"), F.lit("$"))
    page = F.concat(F.lit("Screen_$"), "src", F.lit("$"))
    return _path_steps(spark, sf).select(
        "path_id", F.col("pos").cast("long").alias("pos"), paths.parse_path_token(text).alias("t"),
        paths.start_page_token(page).alias("start_page"),
    ).select("path_id", "pos", "t.type", "t.id", "start_page")


@query(
    "P15_common_descriptions",
    with_ctes(
        "tokens",
        """SELECT chain_id, array_to_string(list_sort(list_intersect(f.d, l.d)), ',') AS common
           FROM (SELECT chain_id, arg_min(src, pos) AS first, arg_max(tgt, pos) AS last FROM tokens GROUP BY 1)
           JOIN desc_ f ON f.page = first JOIN desc_ l ON l.page = last""",
        extra="""
desc_ AS (SELECT event_type AS page, list_sort(list(DISTINCT control)) AS d FROM (
  SELECT event_type, control FROM steps UNION SELECT next_type, control FROM steps WHERE next_type IS NOT NULL)
  GROUP BY 1)""",
    ),
)
def _(spark, sf):
    s = A.steps(spark, sf)
    desc = (
        s.select(F.col("event_type").alias("page"), "control")
        .unionByName(s.filter("next_type is not null").select(F.col("next_type").alias("page"), "control"))
        .groupBy("page").agg(F.collect_set("control").alias("d"))
    )
    ends = A.tokens(spark, sf).groupBy("chain_id").agg(
        F.min_by("src", "pos").alias("first"), F.max_by("tgt", "pos").alias("last")
    )
    return (
        ends.join(desc.select(F.col("page").alias("first"), F.col("d").alias("fd")), "first")
        .join(desc.select(F.col("page").alias("last"), F.col("d").alias("ld")), "last")
        .select("chain_id", F.array_join(paths.common_descriptions(F.col("fd"), F.col("ld")), ",").alias("common"))
    )


@query(
    "P16_chain_text",
    with_ctes(
        "edges",
        """SELECT path_id, string_agg('Step ' || (pos + 1) || ': On the page 【' || coalesce(src_summary, 'Unknown page')
                  || '】, perform the operation 【tap】 on 【' || coalesce(elem_summary, 'Unknown element')
                  || '】 to reach the page 【' || coalesce(tgt_summary, 'Unknown page') || '】.', chr(10) ORDER BY pos) AS text
           FROM enriched GROUP BY path_id""",
        recursive=True, extra=PATH_STEPS,
    ),
)
def _(spark, sf):
    line = paths.operation_line(
        F.col("pos") + 1, F.col("src_summary"), F.lit("tap"), F.col("elem_summary"), F.col("tgt_summary")
    )
    # A path's lines are as many as its steps.
    return _enriched(spark, sf).groupBy("path_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))["line"], "\n").alias("text")
    )


@query(
    "P16_chain_text_targets",
    with_ctes(
        "tokens",
        """SELECT t.chain_id, string_agg('Step ' || (t.pos + 1) || ': On the page 【' || t.src || '】, perform the operation 【tap】 on 【' || t.elem
                  || '】 to reach the page 【' || t.tgt || CASE WHEN t.pos = l.pos THEN coalesce(o.extra, '') ELSE '' END || '】.', chr(10)
                  ORDER BY t.pos) AS text
           FROM tokens t JOIN l USING (chain_id) LEFT JOIN o USING (chain_id) GROUP BY t.chain_id""",
        extra="""
l AS (SELECT chain_id, max(pos) AS pos, arg_max(src, pos) AS src, arg_max(elem, pos) AS elem, arg_max(tgt, pos) AS tgt FROM tokens GROUP BY chain_id),
o AS (SELECT l.chain_id, string_agg(chr(10) || 'additional desc: ' || e.tgt, '' ORDER BY e.tgt) AS extra FROM l
      JOIN (SELECT DISTINCT src, elem, tgt FROM tokens) e ON e.src = l.src AND e.elem = l.elem AND e.tgt <> l.tgt GROUP BY l.chain_id)""",
    ),
)
def _(spark, sf):
    t = A.tokens(spark, sf)
    last = t.groupBy("chain_id").agg(F.max_by(F.struct("pos", "src", "elem", "tgt"), "pos").alias("s")).select("chain_id", "s.*")
    others = alternate_targets(t, last).groupBy("chain_id", "pos").agg(F.array_sort(F.collect_set("other")).alias("extras"))
    steps = t.join(others, ["chain_id", "pos"], "left")
    target = paths.with_extra_targets(F.col("tgt"), F.col("extras"))
    line = paths.operation_line(F.col("pos") + 1, F.col("src"), F.lit("tap"), F.col("elem"), target)
    return steps.groupBy("chain_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))["line"], "\n").alias("text")
    )


@query(
    "P21_chain_reasoning_text",
    with_ctes(
        "edges",
        """SELECT path_id, string_agg('Step ' || (pos + 1) || ' reasoning result:' || chr(10)
                  || '  Context: ' || src || chr(10) || '  Function: ' || coalesce(elem_summary, 'N/A') || chr(10)
                  || '  User intent: N/A' || chr(10) || '  State change: ' || tgt || chr(10)
                  || '  Task relation: N/A' || chr(10), chr(10) ORDER BY pos) AS text
           FROM enriched GROUP BY path_id""",
        recursive=True, extra=PATH_STEPS,
    ),
)
def _(spark, sf):
    reasoning = F.to_json(
        F.struct(F.col("src").alias("context"), F.col("elem_summary").alias("function"), F.col("tgt").alias("state_change"))
    )
    block = paths.reasoning_text(F.col("pos") + 1, reasoning)
    return _enriched(spark, sf).groupBy("path_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("pos", block.alias("t"))))["t"], "\n").alias("text")
    )


@query(
    "P17_serialize_path",
    with_ctes(
        "edges",
        """SELECT task, path_id, 'Page: ' || triplets[1].src || array_to_string(list_transform(triplets,
                  lambda t: ' -- Action: ' || t.elem || ' --> Page: ' || t.tgt), '') AS text FROM paths""",
        recursive=True, extra=PATH_STEPS,
    ),
)
def _(spark, sf):
    text = paths.serialize_steps(
        F.element_at("triplets", 1)["src"], F.col("triplets.elem"), F.col("triplets.tgt")
    )
    return _task_paths(spark, sf).select("task", "path_id", text.alias("text"))


@query(
    "P19_page_actions",
    with_ctes(
        "edges",
        """SELECT e.task || '#' || e.branch || '#' || e.step AS node_id, h.element_id, l.page_id AS target
           FROM edges e JOIN has_element h ON h.page_id = e.tgt JOIN leads_to l ON l.element_id = h.element_id
           JOIN pages_ p ON p.page_id = l.page_id AND p.function_summary IS NOT NULL
           WHERE h.element_id <> e.elem AND l.page_id <> e.src
             AND (NOT EXISTS (SELECT 1 FROM page_steps s WHERE s.page_id = e.tgt AND s.task = e.task)
                  OR NOT EXISTS (SELECT 1 FROM edges s WHERE s.elem = h.element_id AND s.task = e.task)
                  OR EXISTS (SELECT 1 FROM page_steps s WHERE s.page_id = l.page_id AND s.task = e.task))""",
        extra=NODES,
    ),
)
def _(spark, sf):
    t = tables(spark, sf)
    frontier = t["edges"].select(
        F.concat_ws("#", "task", "branch", F.col("step").cast("string")).alias("node_id"), "task",
        F.col("tgt").alias("page_id"), F.col("src").alias("parent_page"), F.array("elem").alias("expanded"),
    )
    return paths.page_actions(
        frontier, t["has_element"], t["leads_to"], t["pages"], t["page_steps"], t["element_steps"]
    ).select("node_id", "element_id", "target")


@query(
    "P20_start_page_pick",
    with_ctes(
        "edges",
        """SELECT app, arg_min(page_id, (rule, page_id)) AS page_id, min(rule) AS rule FROM (
             SELECT task AS app, page_id, CASE WHEN min(z) = 1 THEN 1 ELSE 2 END AS rule FROM (
               SELECT task, page_id, branch, max(CAST(step = 0 AS INT)) AS z FROM (
                 SELECT task, branch, src AS page_id, step FROM edges
                 UNION ALL SELECT task, branch, tgt, step + 1 FROM edges) GROUP BY ALL) GROUP BY ALL)
           GROUP BY app""",
    ),
)
def _(spark, sf):
    e = A.edges(spark, sf)
    ps = e.select(F.col("task").alias("app"), F.col("src").alias("page_id"), F.col("branch").alias("task"), "step").unionByName(
        e.select(F.col("task").alias("app"), F.col("tgt").alias("page_id"), F.col("branch").alias("task"), (F.col("step") + 1).alias("step"))
    )
    return paths.pick_start_page(ps)


@query(
    "W05_shared_page_merge",
    with_ctes(
        "tokens",
        """SELECT path_id, pos, tgt AS shared_page FROM (
             SELECT chain_id AS path_id, pos, tgt, lead(src) OVER (PARTITION BY chain_id ORDER BY pos) AS n FROM tokens)
           WHERE n = tgt""",
    ),
)
def _(spark, sf):
    return paths.adjacent_shared_pages(A.tokens(spark, sf).withColumnRenamed("chain_id", "path_id"))

"""Search-tree, coverage and training-row queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators import training as T
from ..plans import adapters as A
from ..plans.adapters import with_ctes
from ..plans.ordered import is_hot, lag, ordered_columns, row_number
from .paths import COMPOSITES, composites
from .registry import query

UCT = """
uct AS (
  SELECT t.*, p.visits AS parent_visits,
         CASE WHEN t.visits = 0 THEN 'inf'::DOUBLE WHEN p.node_id IS NULL THEN t.value / t.visits
              ELSE t.value / t.visits + 1.4 * sqrt(ln(p.visits) / t.visits) END AS uct
  FROM tree t LEFT JOIN tree p ON p.tree_id = t.tree_id AND p.node_id = t.parent_id)"""


@query("T03_uct", with_ctes("tree", "SELECT tree_id, node_id, round(uct, 9) AS uct FROM uct", extra=UCT))
def _(spark, sf):
    t = T.with_parent_visits(A.tree(spark, sf))
    return t.select("tree_id", "node_id", F.round(T.uct_value(1.4), 9).alias("uct"))


@query(
    "T03_puct",
    with_ctes(
        "tree",
        """SELECT tree_id, node_id, round(CASE WHEN visits = 0 THEN 'inf'::DOUBLE
                  WHEN parent_visits IS NULL THEN value / visits
                  ELSE value / visits + 1.4 * r * sqrt(ln(parent_visits) / visits) END, 9) AS puct FROM uct""",
        extra=UCT,
    ),
)
def _(spark, sf):
    t = T.with_parent_visits(A.tree(spark, sf))
    return t.select("tree_id", "node_id", F.round(T.uct_value(1.4, F.col("r")), 9).alias("puct"))


@query(
    "T04_select_child",
    with_ctes(
        "tree",
        """SELECT tree_id, parent_id, selected, round(uct, 9) AS uct FROM (
             SELECT tree_id, parent_id, node_id AS selected, uct, row_number() OVER (
               PARTITION BY tree_id, parent_id
               ORDER BY CAST(page_name LIKE '%URGENT' AS INT) DESC,
                        CASE WHEN page_name LIKE '%URGENT' THEN 0 ELSE -uct END, node_id) AS i
             FROM uct WHERE parent_id IS NOT NULL AND NOT (depth = 3 AND r = 0)) WHERE i = 1""",
        extra=UCT,
    ),
)
def _(spark, sf):
    t = A.tree(spark, sf).withColumns(
        {"is_gold": F.col("page_name").endswith("URGENT"), "ended": (F.col("depth") == 3) & (F.col("r") == 0)}
    )
    return T.select_child(t).withColumn("uct", F.round("uct", 9))


@query(
    "T05_backprop_totals",
    with_ctes(
        "tree",
        """SELECT tree_id, node_id, round(sum(reward), 4) AS value, CAST(sum(n) AS BIGINT) AS visits FROM (
             SELECT tree_id, unnest(list_concat(action_list, [root])) AS node_id, r AS reward, 1 AS n
             FROM (SELECT t.*, x.node_id AS root FROM tree t JOIN tree x ON x.tree_id = t.tree_id AND x.depth = 0)
             WHERE depth = 3
             UNION ALL SELECT tree_id, node_id, 0, 0 FROM tree) GROUP BY ALL""",
    ),
)
def _(spark, sf):
    t = A.tree(spark, sf)
    rewards = t.filter("depth = 3").select("tree_id", "node_id", F.col("r").alias("reward"))
    return T.backprop_totals(t, rewards).select("tree_id", "node_id", F.round("value", 4).alias("value"), "visits")


TOPK = """
leaves AS (
  SELECT t.tree_id, t.node_id, t.action_list, coalesce((v1.value + v2.value + coalesce(v3.value, 0))
           / nullif(v1.visits + v2.visits + coalesce(v3.visits, 0), 0), 0.0) AS score
  FROM tree t
  JOIN tree v1 ON v1.node_id = t.action_list[1] JOIN tree v2 ON v2.node_id = t.action_list[2]
  LEFT JOIN tree v3 ON v3.node_id = t.action_list[3]
  WHERE t.depth >= 2 AND NOT EXISTS (SELECT 1 FROM tree c WHERE c.parent_id = t.node_id)),
top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY score DESC, node_id) AS rank FROM leaves)
  WHERE rank <= 5)"""


@query(
    "T06_topk_leaf_paths",
    with_ctes("tree", "SELECT tree_id, node_id, round(score, 9) AS score, rank FROM top", extra=TOPK),
)
def _(spark, sf):
    return T.topk_leaf_paths(A.tree(spark, sf), 5).withColumn("score", F.round("score", 9))


Q = """
q3 AS (SELECT tree_id, node_id, parent_id, CASE WHEN r >= 1 THEN 1.0 ELSE r END AS q FROM tree WHERE depth = 3),
q2 AS (SELECT t.tree_id, t.node_id, t.parent_id, coalesce(greatest(t.r, 0.95 * avg(c.q)), t.r) AS q
       FROM tree t LEFT JOIN q3 c ON c.parent_id = t.node_id WHERE t.depth = 2 GROUP BY t.tree_id, t.node_id, t.parent_id, t.r),
q1 AS (SELECT t.tree_id, t.node_id, t.parent_id, coalesce(greatest(t.r, 0.95 * avg(c.q)), t.r) AS q
       FROM tree t LEFT JOIN q2 c ON c.parent_id = t.node_id WHERE t.depth = 1 GROUP BY t.tree_id, t.node_id, t.parent_id, t.r),
q0 AS (SELECT t.tree_id, t.node_id, t.parent_id, coalesce(greatest(t.r, 0.95 * avg(c.q)), t.r) AS q
       FROM tree t LEFT JOIN q1 c ON c.parent_id = t.node_id WHERE t.depth = 0 GROUP BY t.tree_id, t.node_id, t.parent_id, t.r),
q_all AS (SELECT * FROM q3 UNION ALL SELECT * FROM q2 UNION ALL SELECT * FROM q1 UNION ALL SELECT * FROM q0)"""


def _q(spark, sf):
    return T.q_targets(A.tree(spark, sf).withColumn("terminal", F.lit(False)))


@query(
    "T07_q_targets",
    with_ctes("tree", "SELECT tree_id, node_id, round(q, 9) AS q_target FROM q_all", extra=Q),
)
def _(spark, sf):
    return _q(spark, sf).select("tree_id", "node_id", F.round("q_target", 9).alias("q_target"))


# A gold path here is the dearest F order's way: nation, customer, order.
MATCH = """
gold AS (SELECT tree_id, golds[1] AS gold, golds FROM golds),
matched AS (
  SELECT t.*, g.gold, g.golds,
         CASE WHEN t.action_list[1] = g.golds[1][1] THEN CASE WHEN t.action_list[2] = g.golds[1][2]
              THEN CASE WHEN t.action_list[3] = g.golds[1][3] THEN 3 ELSE 2 END ELSE 1 END ELSE 0 END AS m1,
         CASE WHEN t.action_list[1] = g.golds[2][1] THEN CASE WHEN t.action_list[2] = g.golds[2][2]
              THEN CASE WHEN t.action_list[3] = g.golds[2][3] THEN 3 ELSE 2 END ELSE 1 END ELSE 0 END AS m2
  FROM tree t LEFT JOIN gold g ON g.tree_id = t.tree_id)"""


def _gold(spark, sf):
    return A.golds(spark, sf).select("tree_id", F.col("golds")[0].alias("gold"))


@query(
    "T08_gold_match_len",
    with_ctes("golds", "SELECT tree_id, node_id, greatest(m1, m2) AS gold_match FROM matched", extra=MATCH),
)
def _(spark, sf):
    t = A.tree(spark, sf).join(A.golds(spark, sf), "tree_id")
    return t.select("tree_id", "node_id", T.best_gold_match(F.col("action_list"), F.col("golds")).alias("gold_match"))


GOLD_TOKENS = """
gold_list AS (
  SELECT control, row_number() OVER (ORDER BY n DESC, control) AS i FROM (SELECT control, count(*) AS n FROM steps GROUP BY 1)),
chains AS (SELECT task || '/' || branch AS chain_id, step, control FROM steps),
r AS (
  SELECT DISTINCT chain_id, 0 AS m, -1 AS at FROM chains
  UNION ALL
  SELECT r.chain_id, r.m + 1, CAST(min(c.step) AS INTEGER) FROM r JOIN gold_list g ON g.i = r.m + 1
  JOIN chains c ON c.chain_id = r.chain_id AND c.step > r.at AND c.control = g.control GROUP BY r.chain_id, r.m)"""


@query(
    "T08_gold_match_rounds",
    with_ctes(
        "steps",
        "SELECT chain_id, max(m) AS matched FROM r GROUP BY chain_id",
        recursive=True,
        extra=GOLD_TOKENS,
    ),
)
def _(spark, sf):
    s = A.steps(spark, sf).select(
        F.concat_ws("/", "task", "branch").alias("chain_id"), F.col("step").alias("pos"), F.col("control").alias("action")
    )
    # The gold list: all controls, the most used first.
    counts = s.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    gold = ordered_columns(counts, [], [F.desc("n"), "action"], [row_number("i")]).select("action", (F.col("i") - 1).alias("i"))
    return T.gold_match_rounds(s, gold).select("chain_id", "matched")


@query(
    "T09_gold_state",
    with_ctes(
        "golds",
        """SELECT m.tree_id, m.node_id, greatest(m.m1, m.m2) AS gold_match, m.m1 = 3 OR m.m2 = 3 AS terminal,
                  m.m1 = 3 OR m.m2 = 3 OR greatest(m.m1, m.m2) > coalesce(greatest(p.m1, p.m2), 0) AS is_gold,
                  CASE WHEN m.m1 = 3 OR m.m2 = 3 THEN 1.0 ELSE m.r END AS r
           FROM matched m LEFT JOIN matched p ON p.tree_id = m.tree_id AND p.node_id = m.parent_id""",
        extra=MATCH,
    ),
)
def _(spark, sf):
    return T.gold_state(A.tree(spark, sf), A.golds(spark, sf))


@query(
    "T09b_terminal_actions",
    with_ctes("golds", "SELECT tree_id, node_id FROM matched WHERE m1 = 3 OR m2 = 3", extra=MATCH),
)
def _(spark, sf):
    t = A.tree(spark, sf).join(A.golds(spark, sf), "tree_id")
    return t.filter(T.is_terminal(F.col("action_list"), F.col("golds"))).select("tree_id", "node_id")


@query(
    "T09c_child_matching_prefix",
    with_ctes(
        "golds",
        """SELECT m.tree_id, m.parent_id AS node_id, m.node_id AS child_id, m.m1 AS length
           FROM matched m WHERE m.depth >= 1 AND m.m1 = m.depth""",
        extra=MATCH,
    ),
)
def _(spark, sf):
    t = A.tree(spark, sf)
    targets = t.join(_gold(spark, sf), "tree_id").select(
        "tree_id", "node_id", F.col("gold").alias("target"), F.col("depth").alias("matched")
    )
    return T.child_matching_prefix(t, targets)


@query(
    "T10_path_covered",
    with_ctes(
        "golds",
        """SELECT tree_id, node_id, m1 = 3 AS covered, round(m1 / 3, 9) AS fraction, m1 AS matched,
                  CASE WHEN m1 > 0 THEN gold[m1] END AS last_matched FROM matched WHERE depth = 3""",
        extra=MATCH,
    ),
)
def _(spark, sf):
    t = A.tree(spark, sf).filter("depth = 3").join(_gold(spark, sf), "tree_id")
    return t.select("tree_id", "node_id", T.path_covered(F.col("action_list"), F.col("gold")).alias("c")).select(
        "tree_id", "node_id", "c.covered", F.round("c.fraction", 9).alias("fraction"), "c.matched", "c.last_matched"
    )


@query(
    "T11_tree_coverage",
    with_ctes(
        "golds",
        "SELECT tree_id, max(m1) AS covered_steps, max(len(gold)) AS gold_length FROM matched GROUP BY tree_id",
        extra=MATCH,
    ),
)
def _(spark, sf):
    return T.tree_coverage(A.tree(spark, sf), _gold(spark, sf))


def _top(spark, sf):
    t = A.tree(spark, sf)
    return T.topk_leaf_paths(t, 5).join(t.select("tree_id", "node_id", "action_list"), ["tree_id", "node_id"])


BY_TASK = MATCH + "," + TOPK + """,
seen AS (
  SELECT p.tree_id, p.rank, m.m1 = 3 AS full_cover, m.m1 / 3 AS fraction,
         m.m1 = 3 OR list_contains(p.action_list, m.golds[1][3]) OR list_contains(p.action_list, m.golds[2][3]) AS counts
  FROM top p JOIN matched m ON m.tree_id = p.tree_id AND m.node_id = p.node_id),
stopped AS (
  SELECT s.*, min(CASE WHEN counts THEN rank END) OVER (PARTITION BY tree_id) AS stop_rank FROM seen s),
by_task AS (
  SELECT tree_id, max(stop_rank) AS covered_rank, min(CASE WHEN full_cover THEN rank END) AS strict_rank,
         CASE WHEN max(stop_rank) IS NOT NULL THEN 1.0 ELSE max(fraction) END AS covered_rate
  FROM stopped WHERE stop_rank IS NULL OR rank <= stop_rank GROUP BY tree_id)"""


@query(
    "T12_coverage_by_task",
    with_ctes(
        "golds",
        "SELECT tree_id, covered_rank, strict_rank, round(covered_rate, 9) AS covered_rate FROM by_task",
        extra=BY_TASK,
    ),
)
def _(spark, sf):
    by = T.coverage_by_task(_top(spark, sf), _gold(spark, sf), A.golds(spark, sf))
    return by.withColumn("covered_rate", F.round("covered_rate", 9))


@query(
    "T12_coverage_report",
    with_ctes(
        "golds",
        """SELECT count(*) AS n_tasks, count(covered_rank) AS covered_count, count(covered_rank) / count(*) AS covered_rate,
                  coalesce(avg(covered_rank), 0.0) AS mean_rank, count(strict_rank) AS strict_count,
                  count(strict_rank) / count(*) AS strict_rate, coalesce(avg(strict_rank), 0.0) AS strict_mean_rank,
                  round(avg(coalesce(covered_rate, 0.0)), 9) AS inner_rate, round(avg(steps / 3), 9) AS tree_rate
           FROM (SELECT tree_id, max(m1) AS steps FROM matched GROUP BY tree_id) LEFT JOIN by_task USING (tree_id)""",
        extra=BY_TASK,
    ),
)
def _(spark, sf):
    gold = _gold(spark, sf)
    by = T.coverage_by_task(_top(spark, sf), gold, A.golds(spark, sf))
    out = T.coverage_report(by, T.tree_coverage(A.tree(spark, sf), gold))
    return out.withColumns({c: F.round(c, 9) for c in ("inner_rate", "tree_rate")})


@query(
    "T13_gold_value_gap",
    with_ctes(
        "golds",
        """SELECT tree_id, round(avg(q), 5) AS gold_q, round(avg(u), 5) AS gold_u, round(avg(q + u), 5) AS gold_uct,
                  round(avg(CASE WHEN n > 1 THEN (sq - q) / (n - 1) ELSE 0 END), 5) AS avg_others_q,
                  round(avg(CASE WHEN n > 1 THEN (suct - q - u) / (n - 1) ELSE 0 END), 5) AS avg_others_uct,
                  count(*) AS steps
           FROM (SELECT *, count(*) OVER w AS n, sum(q) OVER w AS sq, sum(q + u) OVER w AS suct FROM kids
                 WINDOW w AS (PARTITION BY tree_id, parent_id)) WHERE m1 = depth GROUP BY tree_id""",
        extra=MATCH + """,
kids AS (
  SELECT c.tree_id, c.parent_id, c.depth, c.m1,
         CASE WHEN c.visits > 0 THEN c.value / c.visits ELSE 0.0 END AS q,
         CASE WHEN c.visits > 0 AND p.visits > 1 THEN 5.0 * sqrt(ln(p.visits) / c.visits) ELSE 0.0 END AS u
  FROM matched c JOIN matched p ON p.tree_id = c.tree_id AND p.node_id = c.parent_id)""",
    ),
)
def _(spark, sf):
    out = T.gold_value_gap(A.tree(spark, sf), _gold(spark, sf), 5.0)
    return out.select("tree_id", *[F.round(c, 5).alias(c) for c in out.columns[1:6]], "steps")


def _diagnostic(spark, sf):
    """Trees without their R orders' gold leaves, so that some gold paths break off."""
    t = A.tree(spark, sf)
    gold = _gold(spark, sf)
    q = _q(spark, sf).select("tree_id", "node_id", "q_target")
    # A quarter of the gold leaves' siblings stay; the gold leaf itself is cut.
    cut = t.join(gold, "tree_id").filter(F.col("node_id") == F.element_at("gold", -1)).select("tree_id", "node_id")
    pruned = t.join(cut, ["tree_id", "node_id"], "left_anti").join(q, ["tree_id", "node_id"])
    return T.failure_diagnostic(pruned, gold, 8)


DIAG = MATCH + "," + Q + """,
at_node AS (SELECT tree_id, node_id, gold FROM matched WHERE depth = 2 AND m1 = 2),
kids AS (
  SELECT c.tree_id, c.node_id AS child_id, CASE WHEN c.visits > 0 THEN c.value / c.visits END AS mean, q.q AS q_target
  FROM at_node a JOIN tree c ON c.tree_id = a.tree_id AND c.parent_id = a.node_id AND c.node_id <> a.gold[3]
  JOIN q_all q ON q.tree_id = c.tree_id AND q.node_id = c.node_id)"""


@query(
    "T14_failure_diagnostic",
    with_ctes(
        "golds",
        """SELECT a.tree_id, CASE WHEN k.n IS NULL THEN 'tree_leaf_before_gold_complete'
                    ELSE 'gold_next_action_not_in_expanded_children' END AS reason,
                  2 AS matched_prefix, a.gold[3] AS missing_action, a.node_id AS divergence_node,
                  coalesce(k.n, 0) AS child_count, k.by_mean AS best_by_mean, k.by_target AS best_by_target,
                  CAST(NULL AS VARCHAR) AS correct_child, 3 AS gold_length
           FROM at_node a LEFT JOIN (
             SELECT tree_id, count(*) AS n, arg_min(child_id, (-coalesce(mean, -1e9), child_id)) AS by_mean,
                    arg_min(child_id, (-q_target, child_id)) AS by_target FROM kids GROUP BY tree_id) k
           ON k.tree_id = a.tree_id""",
        extra=DIAG,
    ),
)
def _(spark, sf):
    return _diagnostic(spark, sf)[0]


@query(
    "T14_top_children",
    with_ctes(
        "golds",
        """SELECT tree_id, rank, child_id, round(mean, 9) AS mean, round(q_target, 9) AS q_target FROM (
             SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY coalesce(mean, -1e9) DESC, child_id) AS rank
             FROM kids) WHERE rank <= 8""",
        extra=DIAG,
    ),
)
def _(spark, sf):
    return _diagnostic(spark, sf)[1].withColumns({c: F.round(c, 9) for c in ("mean", "q_target")})


PROMPT = """'<|user|>:' || chr(10) || 'Task: ' || {task} || chr(10) || chr(10) || 'You are at: ' || {page}
  || chr(10) || chr(10) || 'Executed path: ' || {hist} || chr(10) || chr(10) || 'Proposed action:' || chr(10)
  || '<|assistant|>: ' || {action} || '<end_of_step>'"""


@query(
    "T15_sample_export",
    with_ctes(
        "tree",
        "SELECT "
        + PROMPT.format(
            task="'visit ' || c.tree_id", page="p.page_name",
            hist="coalesce(nullif(array_to_string(p.action_list, ' -> '), ''), 'Start of Task')",
            action="c.action_list[-1]",
        )
        + """ AS text, round(q.q, 9) AS label, p.node_id AS page_id, c.action_list[-1] AS action_raw, c.r = 1 AS is_gold
           FROM tree c JOIN tree p ON p.tree_id = c.tree_id AND p.node_id = c.parent_id
           JOIN q_all q ON q.tree_id = c.tree_id AND q.node_id = c.node_id""",
        extra=Q,
    ),
)
def _(spark, sf):
    t = A.tree(spark, sf).withColumn("is_gold", F.col("r") == 1)
    instr = t.select("tree_id").distinct().withColumn("instruction", F.concat(F.lit("visit "), "tree_id"))
    rows = T.training_rows(t, _q(spark, sf), instr)
    return rows.select("text", F.round("label", 9).alias("label"), "metadata.*")


HISTORY = """
hist AS (
  SELECT conv_id, turn, text, role, lag(role) OVER w AS r1, lag(role, 2) OVER w AS r2
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def _frontier(spark, sf):
    c = A.table(spark, sf, "conversations")
    hot = is_hot(c, ["conv_id"])
    h = ordered_columns(c, ["conv_id"], ["turn"], [lag("r1", "role")], hot=hot)
    h = ordered_columns(h, ["conv_id"], ["turn"], [lag("r2", "r1")], hot=hot)
    hist = F.array_compact(F.array("r2", "r1"))
    return h.select(
        "conv_id", "turn",
        T.score_prompt(F.lit("chat"), F.col("role"), hist, F.col("text")).alias("prompt"),
        T.history_text(hist).alias("history"),
    )


@query(
    "T15b_history_text",
    "WITH " + HISTORY.strip() + """
    SELECT conv_id, turn, coalesce(nullif(concat_ws(' -> ', r2, r1), ''), 'Start of Task') AS history FROM hist""",
)
def _(spark, sf):
    return _frontier(spark, sf).select("conv_id", "turn", "history")


@query(
    "T15b_transition_parts",
    with_ctes("tokens", "SELECT chain_id, pos, src, elem AS action, tgt FROM tokens"),
)
def _(spark, sf):
    t = A.tokens(spark, sf)
    text = F.concat(F.lit("<From: "), "src", F.lit(" --[action: "), "elem", F.lit("]--> To: "), "tgt", F.lit(">"))
    return t.select("chain_id", "pos", T.transition_parts(text).alias("p")).select("chain_id", "pos", "p.*")


@query(
    "T01_frontier_scoring",
    "WITH " + HISTORY.strip() + " SELECT conv_id, turn, length("
    + PROMPT.format(
        task="'chat'", page="role", hist="coalesce(nullif(concat_ws(' -> ', r2, r1), ''), 'Start of Task')", action="text"
    )
    + ") / 1000.0 AS score FROM hist",
)
def _(spark, sf):
    scored = T.score_frontier(
        _frontier(spark, sf), lambda pdf: pdf["prompt"].str.len() / 1000.0, ["conv_id", "turn", "prompt"]
    )
    return scored.select("conv_id", "turn", "score")


BEAM_DEPTH = 60
BEAM_LEVEL = """
l{d} AS MATERIALIZED (
  SELECT * FROM (
    SELECT task, {d} AS depth, row_number() OVER (PARTITION BY task ORDER BY score DESC, path) AS rank, path, score, page, visited
    FROM (SELECT f.task, CASE WHEN f.path = '' THEN e.path ELSE f.path || ' ' || e.path END AS path,
                 f.score + e.w AS score, e.tgt AS page, list_concat(f.visited, e.pages) AS visited
          FROM l{p} f JOIN single_steps e ON e.src = f.page WHERE NOT list_has_any(f.visited, e.pages)))
  WHERE rank <= 3)"""
# Moves of all tasks in one graph; forced walks of up to ten moves are part of a step.
BEAM_STEPS = (
    COMPOSITES
    + """,
moves AS MATERIALIZED (
  SELECT src, move, tgt, CAST(count(*) AS DOUBLE) AS w
  FROM (SELECT src, elem AS move, tgt FROM edges UNION ALL SELECT src, action, tgt FROM composites) GROUP BY ALL),
choices AS (SELECT src, count(DISTINCT move) AS n, arg_min({'m': move, 't': tgt, 'w': w}, (move, tgt)) AS one FROM moves GROUP BY src),
walk AS (
  SELECT src AS start, one.t AS page, one.m AS path, [one.t] AS pages, one.w AS w, 1 AS n FROM choices WHERE n = 1 AND one.t <> src
  UNION ALL
  SELECT k.start, c.one.t, k.path || ' ' || c.one.m, list_append(k.pages, c.one.t), k.w + c.one.w, k.n + 1
  FROM walk k JOIN choices c ON c.src = k.page AND c.n = 1
  WHERE k.n < 10 AND c.one.t <> k.start AND NOT list_contains(k.pages, c.one.t)),
ends AS (SELECT k.*, c.n AS open FROM walk k LEFT JOIN choices c ON c.src = k.page
  WHERE k.n = 10 OR c.n IS NULL OR c.n > 1 OR c.one.t = k.start OR list_contains(k.pages, c.one.t)),
single_steps AS MATERIALIZED (
  SELECT src, move AS path, [tgt] AS pages, tgt, w FROM moves WHERE src NOT IN (SELECT src FROM choices WHERE n = 1) AND tgt <> src
  UNION ALL
  SELECT e.start, e.path || ' ' || m.move, list_append(e.pages, m.tgt), m.tgt, e.w + m.w FROM ends e JOIN moves m ON m.src = e.page
  WHERE (e.open > 1 OR e.n = 10) AND m.tgt <> e.start AND NOT list_contains(e.pages, m.tgt)
  UNION ALL
  SELECT start, path, pages, page, w FROM ends WHERE open IS NULL OR (n < 10 AND open = 1)),
l0 AS (SELECT DISTINCT task, src AS page, '' AS path, 0.0::DOUBLE AS score, [src] AS visited FROM edges WHERE step = 0),"""
)


@query(
    "T02_beam_paths",
    with_ctes(
        "edges",
        " UNION ALL ".join(f"SELECT task, depth, rank, path, score FROM l{d}" for d in range(1, BEAM_DEPTH + 1)),
        recursive=True,
        extra=BEAM_STEPS + ",".join(BEAM_LEVEL.format(d=d, p=d - 1) for d in range(1, BEAM_DEPTH + 1)),
    ),
)
def _(spark, sf):
    e = A.shared_edges(spark, sf)
    starts = e.filter("step = 0").groupBy("task", F.col("src").alias("page_id")).agg(F.lit(1)).select("task", "page_id")
    both = e.select("src", F.col("elem").alias("move"), "tgt").unionByName(composites(e).select("src", F.col("action").alias("move"), "tgt"))
    moves = both.groupBy("src", "move", "tgt").agg(F.count(F.lit(1)).alias("weight")).withColumn("graph", F.lit("all"))
    return S.beam_paths(starts, S.collapsed_steps(moves), beam=3, depth=BEAM_DEPTH)


# ------------------------------------------------------------- rounds and samples


@query(
    "T16_round_batch",
    with_ctes(
        "steps",
        """SELECT s.slot, t.task FROM (SELECT unnest(range(0, 40)) AS slot) s
           JOIN (SELECT task, row_number() OVER (ORDER BY task) - 1 AS i, count(*) OVER () AS n
                 FROM (SELECT DISTINCT task FROM steps)) t ON (s.slot + 130) % t.n = t.i""",
    ),
)
def _(spark, sf):
    tasks = A.steps(spark, sf).select("task").distinct()
    return T.round_batch(tasks, "task", 130, 40)


HASH = "CAST('0x' || substr(md5({key} || '_42'), 1, 8) AS BIGINT)"


@query(
    "T17_split",
    f"""SELECT doc_id, CASE WHEN {HASH.format(key='doc_id')} < 4080218931 THEN 'train' ELSE 'test' END AS split
        FROM documents""",
)
def _(spark, sf):
    return T.hash_split(A.table(spark, sf, "documents").select("doc_id"), "doc_id")


@query(
    "T18_label_stats",
    """SELECT count(quality) AS n, count(*) FILTER (quality > 0) AS positives, round(avg(quality), 9) AS mean,
              round(stddev_pop(quality), 9) AS std, min(quality) AS min, max(quality) AS max FROM labels""",
)
def _(spark, sf):
    out = T.label_stats(A.table(spark, sf, "labels"), "quality")
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "std")})


@query(
    "T19_balanced_sample",
    f"""SELECT doc_id, toxic FROM (
          SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic > 0 ORDER BY {HASH.format(key='doc_id')}, doc_id) AS i,
                 count(*) FILTER (toxic > 0) OVER () AS n_pos FROM labels)
        WHERE i <= CASE WHEN toxic > 0 THEN least(n_pos, 20) ELSE 40 - least(n_pos, 20) END""",
)
def _(spark, sf):
    return T.balanced_sample(A.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "toxic", 40)


@query(
    "T20_regression_metrics",
    """SELECT round(avg((p_size / 50 - p_retailprice / 2000) ** 2), 8) AS mse,
              round(avg(abs(p_size / 50 - p_retailprice / 2000)), 8) AS mae FROM part""",
)
def _(spark, sf):
    p = A.table(spark, sf, "part").select(
        (F.col("p_size") / 50).alias("pred"), (F.col("p_retailprice") / 2000).alias("label")
    )
    return T.regression_metrics(p, "label", "pred").select(F.round("mse", 8).alias("mse"), F.round("mae", 8).alias("mae"))


@query(
    "T21_pair_weight",
    """SELECT o_orderkey, round(CASE WHEN pos = 0 OR neg = 0 THEN 1.0 / (pos + neg) ELSE 1.0 / (pos * neg) END, 8) AS weight
       FROM (SELECT l_orderkey AS o_orderkey, count(*) FILTER (l_returnflag = 'R') AS pos,
                    count(*) FILTER (l_returnflag <> 'R') AS neg FROM lineitem GROUP BY 1)""",
)
def _(spark, sf):
    li = A.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("pos"), F.count_if(F.col("l_returnflag") != "R").alias("neg")
    )
    return li.select("o_orderkey", F.round(T.pair_weight(F.col("pos"), F.col("neg")), 8).alias("weight"))


@query(
    "T22_pair_accuracy",
    """SELECT round(avg(CAST(a.best > a.worst_next AS DOUBLE)), 8) AS accuracy FROM (
         SELECT l_orderkey, max(l_extendedprice) FILTER (l_returnflag = 'R') AS best,
                max(l_extendedprice) FILTER (l_returnflag = 'A') AS worst_next FROM lineitem GROUP BY 1) a
       WHERE best IS NOT NULL AND worst_next IS NOT NULL""",
)
def _(spark, sf):
    price = F.col("l_extendedprice")
    pairs = (
        A.table(spark, sf, "lineitem").groupBy("l_orderkey")
        .agg(
            F.max(F.when(F.col("l_returnflag") == "R", price)).alias("chosen"),
            F.max(F.when(F.col("l_returnflag") == "A", price)).alias("rejected"),
        )
        .filter("chosen IS NOT NULL AND rejected IS NOT NULL")
    )
    return T.pair_accuracy(pairs, "chosen", "rejected").select(F.round("accuracy", 8).alias("accuracy"))


@query(
    "T23_cumulative_pool",
    """SELECT round, n_new, CAST(sum(n_new) OVER (ORDER BY round) AS BIGINT) AS n_pool
       FROM (SELECT year(o_orderdate) AS round, count(*) AS n_new FROM orders GROUP BY 1)""",
)
def _(spark, sf):
    s = A.table(spark, sf, "orders").select(F.year("o_orderdate").alias("round"))
    return T.pool_sizes(s)

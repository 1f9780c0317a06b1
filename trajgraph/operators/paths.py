"""Path enumeration, rewriting and rendering over the page/element graph.

Paths grow by one frontier join per depth for all tasks and start pages at once.
A path is a row; its steps are an array on that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import durable, kept, written
from ..plans.ordered import is_hot, lag, lead, ordered_columns, running_sum
from .search import forced_walks


# ---------------------------------------------------------------- enumeration


def task_step_edges(
    has_element: DataFrame,
    leads_to: DataFrame,
    page_steps: DataFrame,
    element_steps: DataFrame,
) -> DataFrame:
    """Edges a task may take at a step: page has s, element has s, next page has s+1.

    ``has_element(page_id, element_id)``, ``leads_to(element_id, page_id)``,
    ``page_steps(page_id, task, step)``, ``element_steps(element_id, task, step)``.

    The graph is stored, so that Spark knows its size and the far more steps are not
    shuffled for a small one.  Both looks at the page steps use the same shuffle of them,
    ordered by the task first, as it tells most rows apart.  Inputs are made distinct,
    hence the edges are.
    """
    src = kept(has_element.select(F.col("page_id").alias("src"), F.col("element_id").alias("elem")).distinct(), "has-element")
    tgt = kept(leads_to.select(F.col("element_id").alias("elem"), F.col("page_id").alias("tgt")).distinct(), "leads-to")
    at = page_steps.select("task", F.col("page_id").alias("src"), "step").distinct()
    after = at.select("task", F.col("src").alias("tgt"), F.col("step").alias("next_step"))
    el = element_steps.select(F.col("element_id").alias("elem"), "task", "step").distinct()
    return (
        el.join(src, "elem")
        .join(at, ["task", "src", "step"], "left_semi")
        .join(tgt, "elem")
        .withColumn("next_step", F.col("step") + 1)
        .join(after, ["task", "tgt", "next_step"], "left_semi")
        .select("task", "step", "src", "elem", "tgt")
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def task_paths(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """All paths of every (task, start page, start step), following step order.

    ``starts(task, page_id, step)``; ``edges`` from :func:`task_step_edges`.  A path
    ends where its page has no edge at the next step.  The step grows by one per
    level, so the edges are stored by step and each level reads only its own;
    with one start step every edge is read once.  A level is written once and only
    its needed columns are read.  Paths are distinct by ``path_id``.
    """
    steps = written(edges.withColumn("step", F.col("step").cast("int")), "step-edges", ["step"])
    reach = steps.agg(F.max("step")).first()[0]
    low, high = starts.agg(F.min("step"), F.max("step")).first()
    frontier = starts.select(
        "task",
        F.col("page_id").alias("start_page"),
        F.col("page_id").alias("page"),
        F.col("step").cast("int").alias("step"),
        # Fixed value: the layout of path ids.
        F.concat(F.lit("P:"), F.col("page_id")).alias("path_id"),
        F.expr("CAST(array() AS array<struct<src:string,elem:string,tgt:string>>)").alias("triplets"),
    ).distinct()
    finished = []
    # One level more than there are steps lets the longest paths end.
    for depth in range(0 if reach is None or low is None else reach - low + 2):
        here = steps.filter(F.col("step").between(low + depth, high + depth)).select(
            "task", "step", F.col("src").alias("page"), "elem", "tgt"
        )
        level = kept(frontier.join(here, ["task", "step", "page"], "left"), "path-level")
        finished.append(
            level.filter(F.col("tgt").isNull() & (F.size("triplets") > 0)).select(
                "task", "start_page", F.col("page").alias("leaf_page"), "path_id", "triplets"
            )
        )
        frontier = level.filter(F.col("tgt").isNotNull()).select(
            "task",
            "start_page",
            F.col("tgt").alias("page"),
            (F.col("step") + 1).alias("step"),
            # Fixed value: the layout of path ids.
            F.concat("path_id", F.lit("->E:"), "elem", F.lit("->P:"), "tgt").alias("path_id"),
            F.concat(
                "triplets",
                F.array(
                    F.struct(F.col("page").alias("src"), F.col("elem"), F.col("tgt"))
                ),
            ).alias("triplets"),
        )
    if not finished:
        return frontier.limit(0).select("task", "start_page", F.col("page").alias("leaf_page"), "path_id", "triplets")
    out = _union(finished)
    # Equal paths can only come from different start steps.
    return out if low == high else out.dropDuplicates(["task", "path_id"])


def all_chains(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Root-to-leaf chains inside each graph, without step constraints.

    ``roots(graph, page_id)``, ``edges(graph, src, elem, tgt)``.  A chain never
    visits a page twice, which both ends the loop and is stricter than the
    "no repeated edge" rule of graph pattern matching; a chain ends at a page
    without outgoing edges, so walks that can only close a cycle give no chain.
    """
    edges = durable(edges.select("graph", F.col("src").alias("page"), "elem", "tgt").distinct())
    frontier = roots.select(
        "graph",
        F.col("page_id").alias("start_page"),
        F.col("page_id").alias("page"),
        # Fixed value: the layout of path ids.
        F.concat(F.lit("P:"), F.col("page_id")).alias("path_id"),
        F.array("page_id").alias("visited"),
        F.lit(0).alias("n_steps"),
    )
    finished = []
    while True:
        level = durable(frontier.join(edges, ["graph", "page"], "left"))
        finished.append(
            level.filter(F.col("tgt").isNull() & (F.col("n_steps") > 0)).select(
                "graph", "start_page", F.col("page").alias("leaf_page"), "path_id", "n_steps"
            )
        )
        frontier = level.filter(
            F.col("tgt").isNotNull() & ~F.array_contains("visited", F.col("tgt"))
        ).select(
            "graph",
            "start_page",
            F.col("tgt").alias("page"),
            # Fixed value: the layout of path ids.
            F.concat("path_id", F.lit("->E:"), "elem", F.lit("->P:"), "tgt").alias("path_id"),
            F.concat("visited", F.array("tgt")).alias("visited"),
            (F.col("n_steps") + 1).alias("n_steps"),
        )
        if frontier.isEmpty():
            break
    return _union(finished)


def first_chains(chains: DataFrame) -> DataFrame:
    """The first chain (by id) of every start page and graph."""
    return chains.groupBy("graph", "start_page").agg(
        F.min("path_id").alias("path_id"),
        F.min_by("n_steps", "path_id").alias("n_steps"),
        F.min_by("leaf_page", "path_id").alias("leaf_page"),
    )


def pick_start_page(page_steps: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """One start page per app: the given one, else one whose every task has step 0,
    else the first page.  ``page_steps(app, page_id, task, step)``,
    ``wanted(app, page_id)``."""
    zero = page_steps.groupBy("app", "page_id", "task").agg(
        F.max((F.col("step") == 0).cast("int")).alias("z")
    )
    rules = zero.groupBy("app", "page_id").agg(F.min("z").alias("z")).select(
        "app", "page_id", F.when(F.col("z") == 1, 1).otherwise(2).alias("rule")
    )
    if wanted is not None:
        rules = rules.unionByName(wanted.select("app", "page_id", F.lit(0).alias("rule")))
    best = F.min(F.struct("rule", "page_id"))
    return rules.groupBy("app").agg(best.alias("b")).select("app", "b.page_id", "b.rule")


# ------------------------------------------------------------- forced chains


def forced_chains(edges: DataFrame, actions: DataFrame | None = None, max_length: int = 10) -> DataFrame:
    """Follow pages that offer exactly one choice, up to ``max_length`` of them.

    ``edges(graph, src, elem, tgt)``, and ``actions(graph, src, action, tgt)`` for the composite actions of a page; both
    count as choices.  The walk stops at a page with more or fewer choices and never revisits a page.
    One row per start page whose first step is forced.
    """
    moves = edges.select("graph", "src", F.col("elem").alias("move"), "tgt", F.lit(0.0).alias("weight"))
    if actions is not None:
        moves = moves.unionByName(actions.select("graph", "src", F.col("action").alias("move"), "tgt", F.lit(0.0).alias("weight")))
    return forced_walks(moves, max_length).select("graph", "start_page", "end_page", "forced")


def page_actions(
    frontier: DataFrame,
    has_element: DataFrame,
    leads_to: DataFrame,
    pages: DataFrame,
    page_tasks: DataFrame,
    element_tasks: DataFrame,
) -> DataFrame:
    """Element moves open to each frontier node.

    ``frontier(node_id, task, page_id, parent_page, expanded ARRAY)``.  Leaves out
    expanded elements, moves back to the parent page, targets without a summary
    and, when page and element belong to the task, targets that do not.
    """
    named = pages.filter(F.col("function_summary").isNotNull()).select(
        F.col("page_id").alias("target"), F.col("function_summary").alias("target_summary")
    )
    leads = leads_to.select("element_id", F.col("page_id").alias("target"))
    moves = has_element.select("page_id", "element_id").join(leads, "element_id").join(named, "target")
    pt = page_tasks.select("page_id", "task").distinct()
    et = element_tasks.select("element_id", "task").distinct()
    # Moves of a task's own elements that leave the task, for each of its pages. They go to the nodes, so that
    # the moves of all nodes, which are far more than the rows of any table here, are never shuffled.
    leaving = (
        et.join(leads.distinct(), "element_id")
        .join(pt.select(F.col("page_id").alias("target"), "task"), ["target", "task"], "left_anti")
        .join(has_element.select("page_id", "element_id").distinct(), "element_id")
        .join(pt, ["page_id", "task"], "left_semi")
        .groupBy("page_id", "task")
        .agg(F.collect_set(F.struct("element_id", "target")).alias("leaving"))
    )
    nodes = frontier.join(leaving, ["page_id", "task"], "left")
    stays = F.col("leaving").isNull() | ~F.array_contains("leaving", F.struct("element_id", "target"))
    return (
        nodes.join(moves, "page_id")
        .filter(~F.array_contains("expanded", F.col("element_id")))
        .filter(~F.col("target").eqNullSafe(F.col("parent_page")))
        .filter(stays)
        .select("node_id", "task", "page_id", "element_id", "target", "target_summary")
    )


# ------------------------------------------------------------ action groups


def matching_groups(path_elements: DataFrame, action_elements: DataFrame) -> DataFrame:
    """Composite actions all of whose elements occur in the path.

    ``path_elements(path_id, element_id)``, ``action_elements(action_id, element_id)``.
    Relational division: the number of matched elements equals the group size.
    """
    members = action_elements.distinct()
    sizes = members.groupBy("action_id").agg(F.count(F.lit(1)).alias("group_size"))
    hits = (
        path_elements.select("path_id", "element_id").distinct()
        .join(members, "element_id")
        .groupBy("path_id", "action_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        hits.join(sizes, "action_id")
        .filter(F.col("n") == F.col("group_size"))
        .select("path_id", "action_id", "group_size")
    )


#: Candidate groups of a path that are folded on its row; a path with more of them goes through rounds.
FOLDED_GROUPS = 64


def choose_groups(matches: DataFrame, action_elements: DataFrame, folded: int = FOLDED_GROUPS) -> DataFrame:
    """Greedy choice per path: longest group first, ties to the smaller id, skipping overlaps.

    The few candidates of most paths are folded as an array on the path's row.  A path with more than ``folded`` of them
    goes through rounds over rows: a group that comes first on every one of its elements is chosen, and groups that share an
    element with a chosen one leave.  The rounds choose what the fold would.
    """
    counted = kept(matches.join(matches.groupBy("path_id").agg(F.count(F.lit(1)).alias("_n")), "path_id"), "group-matches")
    few, many = counted.filter(F.col("_n") <= folded), counted.filter(F.col("_n") > folded)
    members = action_elements.groupBy("action_id").agg(F.array_sort(F.collect_set("element_id")).alias("members"))
    ranked = few.join(members, "action_id").groupBy("path_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("group_size")).alias("neg"), "action_id", "members"))).alias("groups")
    )
    chosen = F.expr(
        "aggregate(groups, CAST(array() AS array<struct<neg:bigint,action_id:string,members:array<string>>>),"
        " (acc, g) -> IF(exists(acc, c -> arrays_overlap(c.members, g.members)), acc,"
        " concat(acc, array(g))))"
    )
    out = ranked.select("path_id", F.explode(chosen).alias("g")).select(
        "path_id", "g.action_id", F.explode("g.members").alias("element_id")
    )
    left = many.join(action_elements.select("action_id", "element_id").distinct(), "action_id")
    left = kept(left.select("path_id", "action_id", (-F.col("group_size")).alias("neg"), "element_id"), "group-candidates")
    while not left.isEmpty():
        first = left.groupBy("path_id", "element_id").agg(F.min(F.struct("neg", "action_id")).alias("first"))
        leads = left.join(first, ["path_id", "element_id"]).groupBy("path_id", "action_id").agg(
            F.bool_and(F.col("first.action_id") == F.col("action_id")).alias("leads")
        )
        won = left.join(leads.filter("leads").select("path_id", "action_id"), ["path_id", "action_id"], "left_semi")
        won = kept(won.select("path_id", "action_id", "element_id"), "chosen-groups")
        out = out.unionByName(won)
        gone = left.join(won.select("path_id", "element_id"), ["path_id", "element_id"], "left_semi").select("path_id", "action_id").distinct()
        left = kept(left.join(gone, ["path_id", "action_id"], "left_anti"), "group-candidates")
    return out


def rewrite_with_groups(path_steps: DataFrame, chosen: DataFrame) -> DataFrame:
    """Replace each run of consecutive member elements by its action.

    ``path_steps(path_id, pos, src, elem, tgt)``.  Runs are found with a
    gaps-and-islands sum; a collapsed step spans the run's first source and last
    target.
    """
    marked = path_steps.join(
        chosen.select("path_id", F.col("element_id").alias("elem"), "action_id"),
        ["path_id", "elem"],
        "left",
    )
    hot = is_hot(path_steps, ["path_id"])
    marked = ordered_columns(marked, ["path_id"], ["pos"], [lag("prev_action", "action_id")], hot=hot)
    fresh = F.when(
        F.col("action_id").isNotNull() & (F.col("action_id") == F.col("prev_action")), 0
    ).otherwise(1)
    islands = ordered_columns(
        marked.withColumn("fresh", fresh), ["path_id"], ["pos"], [running_sum("run", "fresh")], hot=hot,
    )
    return islands.groupBy("path_id", "run").agg(
        F.min_by("src", "pos").alias("src"),
        F.min_by(F.coalesce("action_id", "elem"), "pos").alias("elem"),
        F.max_by("tgt", "pos").alias("tgt"),
        F.max(F.col("action_id").isNotNull()).alias("is_group"),
        F.count(F.lit(1)).alias("n_steps"),
    )


# ---------------------------------------------------------------- rendering


def enrich_steps(path_steps: DataFrame, pages: DataFrame, elements: DataFrame) -> DataFrame:
    """Add node properties to path steps; unknown ids keep null properties.

    The properties are stored, so that Spark knows their size and long tables of steps are
    not shuffled for each of the three joins with small ones.
    """
    pages = kept(pages.select("page_id", "function_summary", "goal"), "page-properties")
    elements = kept(elements.select("element_id", "function_summary", "goal"), "element-properties")
    src = pages.select(
        F.col("page_id").alias("src"),
        F.col("function_summary").alias("src_summary"),
        F.col("goal").alias("src_goal"),
    )
    tgt = pages.select(
        F.col("page_id").alias("tgt"),
        F.col("function_summary").alias("tgt_summary"),
        F.col("goal").alias("tgt_goal"),
    )
    el = elements.select(
        F.col("element_id").alias("elem"),
        F.col("function_summary").alias("elem_summary"),
        F.col("goal").alias("elem_goal"),
    )
    return path_steps.join(src, "src", "left").join(el, "elem", "left").join(tgt, "tgt", "left")


def simplified(src="src", elem="elem", tgt="tgt", is_group: Column | None = None) -> dict[str, Column]:
    """``summary_$id$`` strings of an enriched step."""
    kind = F.lit("Element_") if is_group is None else F.when(is_group, "Action_").otherwise("Element_")

    def text(summary, unknown, prefix, ident):
        return F.concat(
            F.coalesce(F.col(summary), F.lit(unknown)), F.lit("_$"), prefix, F.col(ident), F.lit("$")
        )

    # Placeholders of missing summaries.
    return {
        "source_page": text("src_summary", "Unknown source", F.lit(""), src),
        "element": text("elem_summary", "Unknown element", kind, elem),
        "target_page": text("tgt_summary", "Unknown source", F.lit(""), tgt),
    }


def first_goal(steps: DataFrame) -> DataFrame:
    """First non-empty goal of each path, scanning source, element, target in order."""
    goal = F.filter(
        F.array(F.col("src_goal"), F.col("elem_goal"), F.col("tgt_goal")),
        lambda g: F.coalesce(g, F.lit("")) != "",
    )
    return steps.groupBy("path_id").agg(
        F.coalesce(F.min_by(F.get(goal, F.lit(0)), F.when(F.size(goal) > 0, F.col("pos"))), F.lit(""))
        .alias("goal")
    )


def parse_path_token(text: Column) -> Column:
    """``…_$Element_<id>$`` or ``…_$Action_<id>$`` to a (type, id) struct, else null."""
    # The token layout of exported gold paths.
    pattern = r"(?i)_\$(Element|Action)_([a-f0-9\-]+)\$"
    kind = F.regexp_extract(text, pattern, 1)
    return F.when(
        kind != "", F.struct(F.lower(kind).alias("type"), F.regexp_extract(text, pattern, 2).alias("id"))
    )


def start_page_token(text: Column) -> Column:
    """The page id embedded as ``_$<id>$`` in the first source page."""
    found = F.regexp_extract(text, r"_\$([^$]+)\$", 1)
    return F.when(found != "", found)


def serialize_steps(first: Column, actions: Column, targets: Column) -> Column:
    """``Page: a -- Action: x --> Page: b -- Action: …`` from step arrays."""
    # The layout of serialised candidate paths.
    hops = F.zip_with(
        actions,
        targets,
        lambda a, t: F.concat(F.lit(" -- Action: "), a, F.lit(" --> Page: "), t),
    )
    return F.concat(F.lit("Page: "), first, F.array_join(hops, ""))


def operation_line(step: Column, source: Column, action: Column, element: Column, target: Column) -> Column:
    """Numbered sentence for one step of a chain."""
    # The sentence layout of chain descriptions.
    return F.concat(
        F.lit("Step "), step.cast("string"),
        F.lit(": On the page 【"), F.coalesce(source, F.lit("Unknown page")),
        F.lit("】, perform the operation 【"), F.coalesce(action, F.lit("Unknown operation")),
        F.lit("】 on 【"), F.coalesce(element, F.lit("Unknown element")),
        F.lit("】 to reach the page 【"), F.coalesce(target, F.lit("Unknown page")), F.lit("】."),
    )


def with_extra_targets(target: Column, extras: Column) -> Column:
    """A last step's target followed by the other pages the same operation leads to."""
    # How further targets are introduced.
    shown = lambda page: F.coalesce(page, F.lit("Unknown page"))
    more = F.transform(F.coalesce(extras, F.array().cast("array<string>")), lambda x: F.concat(F.lit("\nadditional desc: "), shown(x)))
    return F.concat(shown(target), F.array_join(more, ""))


def reasoning_text(step: Column, reasoning: Column) -> Column:
    """Numbered reasoning block of one step; missing fields read N/A."""
    # Labels and fields of stored reasoning.
    labels = (
        ("Context", "context"),
        ("Function", "function"),
        ("User intent", "user_intent"),
        ("State change", "state_change"),
        ("Task relation", "task_relation"),
    )
    parts = [F.concat(F.lit("Step "), step.cast("string"), F.lit(" reasoning result:\n"))]
    for label, field in labels:
        parts.append(
            F.concat(
                F.lit(f"  {label}: "),
                F.coalesce(F.get_json_object(reasoning, f"$.{field}"), F.lit("N/A")),
                F.lit("\n"),
            )
        )
    return F.concat(*parts)


def common_descriptions(first: Column, last: Column) -> Column:
    """Task descriptions shared by the first and the last page."""
    return F.array_sort(F.array_intersect(first, last))


def adjacent_shared_pages(path_steps: DataFrame) -> DataFrame:
    """Consecutive steps where one step's target is the next one's source."""
    nxt = ordered_columns(path_steps, ["path_id"], ["pos"], [lead("next_src", "src")])
    return nxt.filter(F.col("next_src") == F.col("tgt")).select(
        "path_id", "pos", F.col("tgt").alias("shared_page")
    )


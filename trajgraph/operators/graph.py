"""Graph memory: node and edge tables, upserts, lookups and exports.

Nodes and edges are plain tables with natural keys.  An upsert is a union
followed by a key-distinct, so it is idempotent and combines map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import lag, lead, ordered_columns, row_number


# ------------------------------------------------------------------- upserts


def merge_edges(
    existing: DataFrame | None,
    new: DataFrame,
    key: list[str],
    endpoints: list[tuple[DataFrame, str, str]],
) -> DataFrame:
    """MERGE edges once per key, only where every endpoint node exists.

    ``endpoints`` lists ``(node table, node column, edge column)``.
    """
    out = new
    for nodes, node_col, edge_col in endpoints:
        ids = nodes.select(F.col(node_col).alias(edge_col))
        out = out.join(ids, edge_col, "left_semi")
    if existing is not None:
        out = existing.unionByName(out.select(*existing.columns))
    return out.dropDuplicates(key)


def merge_task_steps(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """Distinct (node, task, step) rows: the base table behind a node's task map."""
    cols = ["node_id", "task", "step"]
    out = new.select(*cols)
    if existing is not None:
        out = existing.select(*cols).unionByName(out)
    return out.distinct()


def task_step_map(node_steps: DataFrame) -> DataFrame:
    """Sorted distinct steps per (node, task); a step list is at most a chain long."""
    return node_steps.groupBy("node_id", "task").agg(
        F.array_sort(F.collect_set("step")).alias("steps")
    )


def append_goals(goals: DataFrame) -> DataFrame:
    """Distinct goals per node with their insertion rank, as rows.

    ``goals(node_id, goal, seq)``.  Kept long because a popular page may collect
    any number of goals; :func:`goal_list` gives the array form.
    """
    first = goals.groupBy("node_id", "goal").agg(F.min("seq").alias("seq"))
    return first


def goal_list(goals: DataFrame) -> DataFrame:
    """Goal array per node in insertion order, for nodes with few goals."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "goal")))
    return append_goals(goals).groupBy("node_id").agg(ordered["goal"].alias("goals"))


def branch_starts(kept: DataFrame) -> DataFrame:
    """Where every nested branch begins: ``task, branch, start_page, start_depth``.

    The depth is the number of kept steps of all branches above, the page the last one
    of the nearest branch above that has steps.  Branches are joined to their own few
    ancestors, so a folder tree of any depth takes one join.
    """
    ends = kept.groupBy("task", "branch").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("after_hash", "step").alias("last_page")
    )
    parts = F.split("branch", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    nested = ends.filter(F.col("branch") != "").select("task", "branch", F.explode(above).alias("up"))
    return (
        nested.join(ends.withColumnRenamed("branch", "up"), ["task", "up"])
        .groupBy("task", "branch")
        .agg(F.max_by("last_page", F.length("up")).alias("start_page"), F.sum("n").alias("start_depth"))
    )


def fold_trajectories(steps: DataFrame, match: DataFrame | None = None) -> dict[str, DataFrame]:
    """Fold ordered steps of all trajectories into graph tables in one pass.

    ``steps(task, branch, step, before_hash, after_hash, action, goal)``.  Steps with
    no after-screen, or whose screen did not change, are dropped and the
    remaining ones renumbered.  A page is identified by ``match(hash, page_id)``,
    or by its hash; an element by (page, action).

    A branch named ``a/b`` continues the branch ``a`` of its task (and ``a`` the branch
    without a name): it starts on the page and at the depth where the nearest branch
    above it ended.  With a column ``is_leaf`` the last kept step of a leaf branch always
    makes a page of its own.  A page that no step leaves is a placeholder
    (``is_placeholder``) until a later fold finds a step that does.
    """
    kept = steps.filter(valid_transition("before_hash", "after_hash"))
    if match is not None:
        for side in ("before", "after"):
            kept = (
                kept.join(
                    match.select(F.col("hash").alias(f"{side}_hash"), F.col("page_id").alias(f"{side}_page")),
                    f"{side}_hash",
                    "left",
                )
                .withColumn(f"{side}_hash", F.coalesce(f"{side}_page", f"{side}_hash"))
                .drop(f"{side}_page")
            )

    if "is_leaf" in kept.columns:
        ends = kept.groupBy("task", "branch").agg(F.max("step").alias("_end"))
        own = F.concat_ws("/", F.lit("leaf"), "task", "branch")
        last = F.coalesce("is_leaf", F.lit(False)) & (F.col("step") == F.col("_end"))
        kept = kept.join(ends, ["task", "branch"]).withColumn("after_hash", F.when(last, own).otherwise(F.col("after_hash")))

    # The source page of a step is the page the walk stands on: the previous
    # kept step's target, the end of the branch above at the start of a branch, or
    # else the step's own screen.
    walk = ordered_columns(
        kept, ["task", "branch"], ["step"],
        [row_number("rn"), lag("stand", "after_hash")],
    ).join(branch_starts(kept), ["task", "branch"], "left").select(
        "task",
        "branch",
        (F.col("rn") - 1 + F.coalesce("start_depth", F.lit(0))).alias("step"),
        F.coalesce("stand", "start_page", "before_hash").alias("src"),
        F.col("after_hash").alias("tgt"),
        "action",
        "goal",
    ).withColumn("elem", F.sha2(F.concat_ws("\u0001", "src", "action"), 256))
    pages = (
        walk.select(F.col("src").alias("page_id"))
        .unionByName(walk.select(F.col("tgt").alias("page_id")))
        .distinct()
    )
    left = walk.select(F.col("src").alias("page_id"), F.lit(False).alias("is_placeholder")).distinct()
    pages = pages.join(left, "page_id", "left").withColumn("is_placeholder", F.coalesce("is_placeholder", F.lit(True)))
    elements = walk.groupBy(F.col("elem").alias("element_id")).agg(
        F.min("src").alias("page_id"), F.min("action").alias("action")
    )
    page_steps = merge_task_steps(
        walk.select(F.col("src").alias("node_id"), "task", "step"),
        walk.select(F.col("tgt").alias("node_id"), "task", (F.col("step") + 1).alias("step")),
    )
    return {
        "pages": pages,
        "elements": elements,
        "has_element": walk.select(
            F.col("src").alias("page_id"), F.col("elem").alias("element_id")
        ).distinct(),
        "leads_to": walk.select(
            F.col("elem").alias("element_id"), F.col("tgt").alias("page_id"), F.col("action").alias("action_name")
        ).distinct(),
        "page_steps": page_steps,
        "element_steps": merge_task_steps(
            None, walk.select(F.col("elem").alias("node_id"), "task", "step")
        ),
        "page_goals": append_goals(
            walk.select(F.col("src").alias("node_id"), "goal", F.struct("task", "branch", "step").alias("seq"))
            .unionByName(
                walk.select(
                    F.col("tgt").alias("node_id"), "goal", F.struct("task", "branch", "step").alias("seq")
                )
            )
        ),
    }


def valid_transition(before: str, after: str) -> Column:
    """A step counts when its after-screen exists and looks different."""
    return F.col(after).isNotNull() & ~F.col(before).eqNullSafe(F.col(after))


def canonical_pages(
    candidates: DataFrame, used: DataFrame, score: float = 0.98, keep: int = 3, verify: Column | None = None
) -> DataFrame:
    """Stored page that a new screen stands for, at most one per screen.

    ``candidates(screen_id, task, page_id, score)`` from vector search; a page the
    task already uses (``used(task, page_id)``, exact match) is not eligible.  The best
    ``keep`` go to ``verify`` (a boolean column), and the best verified one wins.
    """
    eligible = candidates.filter(F.col("score") > score).join(used, ["task", "page_id"], "left_anti")
    ranked = eligible.withColumn(
        "rank",
        F.expr("row_number() OVER (PARTITION BY screen_id ORDER BY score DESC, page_id)"),
    ).filter(F.col("rank") <= keep)
    if verify is not None:
        ranked = ranked.filter(verify)
    best = F.min(F.struct("rank", "page_id", "score"))
    return ranked.groupBy("screen_id").agg(best.alias("b")).select(
        "screen_id", "b.page_id", "b.score"
    )


def fill_placeholder_pages(pages: DataFrame, observed: DataFrame) -> DataFrame:
    """Give placeholder pages the elements seen when the page was next a source.

    ``observed(page_id, elements, seq)``: the earliest observation wins; real pages
    keep what they have.
    """
    first = observed.groupBy("page_id").agg(F.min_by("elements", "seq").alias("_seen"))
    # Fixed value: the placeholder text of a page not yet left.
    blank = F.col("elements").isNull() | (F.col("elements") == "no transition occurred")
    return (
        pages.join(first, "page_id", "left")
        .withColumn("elements", F.when(blank, F.coalesce("_seen", "elements")).otherwise(F.col("elements")))
        .drop("_seen")
    )


def set_property(nodes: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Set one property where an update exists; nested values are stored as JSON."""
    new = updates.schema["value"].dataType.typeName()
    value = F.to_json("value") if new in ("struct", "array", "map") else F.col("value")
    changed = updates.select(
        F.col("node_id").alias(key), value.alias("_new"), F.lit(True).alias("_set")
    )
    return (
        nodes.join(changed, key, "left")
        .withColumn(column, F.when(F.col("_set"), F.col("_new")).otherwise(F.col(column)))
        .drop("_new", "_set")
    )


def delete_nodes(nodes: DataFrame, key: str, ids: DataFrame, edges: list[tuple[DataFrame, str]]):
    """Remove nodes and every edge that touches them."""
    gone = ids.select(F.col("node_id").alias(key))
    left = nodes.join(gone, key, "left_anti")
    cut = [
        e.join(ids.select(F.col("node_id").alias(col)), col, "left_anti") for e, col in edges
    ]
    return left, cut


def delete_task_cascade(node_tasks: DataFrame, vectors: DataFrame, forgotten: DataFrame):
    """Forget tasks: ``(remaining node_tasks, deleted node ids, remaining vectors)``.

    ``node_tasks(node_id, task)`` in long form, ``forgotten(task)``.  Nodes of no other
    task are deleted along with their vectors.
    """
    remaining = node_tasks.join(forgotten.select("task"), "task", "left_anti")
    deleted = (
        node_tasks.select("node_id")
        .distinct()
        .join(remaining.select("node_id"), "node_id", "left_anti")
    )
    kept = vectors.join(deleted.select(F.col("node_id").alias("id")), "id", "left_anti")
    return remaining, deleted, kept


def task_names(*node_tasks: DataFrame) -> DataFrame:
    """Distinct task names over all node kinds."""
    out = node_tasks[0].select("task")
    for t in node_tasks[1:]:
        out = out.unionByName(t.select("task"))
    return out.filter(F.col("task").isNotNull()).distinct()


def add_other_info(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Append (node, step, task, description) once per (node, step, task)."""
    merged = existing.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    return merged.groupBy("node_id", "step", "task").agg(
        F.min_by("description", F.struct("_p", "description")).alias("description")
    )


def rewrite_ids(nodes: DataFrame, key: str, edges: DataFrame, edge_key: str, salt: str = ""):
    """New unique ids for nodes, carried to their edges.

    The new id is a digest of the old one and ``salt``, so a recomputed task gives
    the same id again; ``uuid()`` would not.
    """
    new = F.sha2(F.concat_ws("\u0001", F.lit(salt), F.col("_old")), 256)
    renamed = nodes.withColumnRenamed(key, "_old").withColumn(key, new)
    relinked = edges.withColumnRenamed(edge_key, "_old").withColumn(edge_key, new).drop("_old")
    return renamed.withColumnRenamed("_old", "old_id"), relinked


def action_key(components: Column) -> Column:
    """Canonical key of an action: its triples with the last target as ``*``."""
    last = F.element_at(components, -1)
    parts = F.split(last, ",")
    short = F.when(
        F.size(parts) >= 2, F.concat_ws(",", F.element_at(parts, 1), F.element_at(parts, 2), F.lit("*"))
    ).otherwise(last)
    head = F.slice(components, 1, F.greatest(F.size(components) - 1, F.lit(0)))
    return F.when(F.size(components) > 0, F.concat_ws(";", F.array_join(head, ";"), short))


def create_actions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New composite actions whose canonical key is not stored yet, one per key.

    Both sides hold ``action_id, components ARRAY<STRING>`` with triples ``src,elem,tgt``.
    """
    keyed = new.withColumn("key", action_key(F.col("components")))
    stored = existing.select(action_key(F.col("components")).alias("key"))
    return (
        keyed.join(stored, "key", "left_anti")
        .groupBy("key")
        .agg(F.min_by(F.struct("action_id", "components"), "action_id").alias("a"))
        .select("a.action_id", "a.components", "key")
    )


def composed_of(actions: DataFrame) -> DataFrame:
    """COMPOSED_OF edges of composite actions: one row per (action, order)."""
    return actions.select(
        "action_id", F.posexplode("components").alias("order", "triple")
    ).select("action_id", "order", F.element_at(F.split("triple", ","), 2).alias("element_id"))


def checked_nodes(rows: DataFrame, required: list[str], json_columns: list[str], now: Column | None = None):
    """Rows ready to store, and rejected rows that miss a required field."""
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    good = rows.filter(complete)
    if "timestamp" in rows.columns:
        good = good.withColumn("timestamp", F.coalesce("timestamp", now if now is not None else F.current_timestamp()))
    for c in json_columns:
        good = good.withColumn(c, F.to_json(c))
    return good, rows.filter(~complete)


# ------------------------------------------------------------------- queries


def neighbourhood(pages: DataFrame, has_element: DataFrame, leads_to: DataFrame) -> DataFrame:
    """page → element → page rows, keeping pages and elements without edges."""
    return (
        pages.select("page_id")
        .join(has_element, "page_id", "left")
        .join(leads_to.select("element_id", F.col("page_id").alias("target")), "element_id", "left")
        .select("page_id", "element_id", "target")
    )


def chain_roots(pages: DataFrame, leads_to: DataFrame) -> DataFrame:
    """Pages nothing leads to."""
    return pages.join(leads_to.select("page_id"), "page_id", "left_anti")


def chain_ends(pages: DataFrame, has_element: DataFrame) -> DataFrame:
    """Pages without elements."""
    return pages.join(has_element.select("page_id"), "page_id", "left_anti")


def leaf_pages(pages: DataFrame, has_element: DataFrame, page_action: DataFrame) -> DataFrame:
    """Pages with neither elements nor actions."""
    return chain_ends(chain_ends(pages, has_element), page_action)


def start_pages(page_steps: DataFrame) -> DataFrame:
    """Pages whose every task lists only step 0; ``page_steps(page_id, task, step)``."""
    return (
        page_steps.groupBy("page_id")
        .agg(F.max("step").alias("hi"), F.min("step").alias("lo"))
        .filter((F.col("hi") == 0) & (F.col("lo") == 0))
        .select("page_id")
    )


def unique_start_page(page_steps: DataFrame) -> DataFrame:
    """As :func:`start_pages`, failing at run time unless there is exactly one."""
    found = start_pages(page_steps).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("page_id"))
    return found.select(
        F.when(F.col("n") == 1, F.col("page_id"))
        .otherwise(F.raise_error(F.concat(F.lit("start pages found: "), F.col("n").cast("string"))))
        .alias("page_id")
    )


def pending_nodes(nodes: DataFrame, column: str, force: bool = False) -> DataFrame:
    """Nodes still without a summary, or all of them when forced."""
    if force:
        return nodes
    return nodes.filter(F.coalesce(F.col(column), F.lit("")) == "")


def node_stats(kinds: dict[str, DataFrame], column: str) -> DataFrame:
    """total / processed / pending per node kind."""
    parts = None
    for kind, nodes in kinds.items():
        part = nodes.select(F.lit(kind).alias("kind"), F.col(column).alias("summary"))
        parts = part if parts is None else parts.unionByName(part)
    done = (F.coalesce("summary", F.lit("")) != "").cast("long")
    return parts.groupBy("kind").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(done).alias("processed"),
        F.sum(1 - done).alias("pending"),
    )


def keyword_actions(actions: DataFrame, text: str) -> DataFrame:
    """High-level actions whose name or description holds ``text``; all if none does."""
    high = actions.filter("is_high_level")
    hit = F.col("name").contains(text) | F.coalesce(F.col("description").contains(text), F.lit(False))
    flagged = high.withColumn("_hit", hit)
    # One bounded row decides between the hits and the fallback.
    any_hit = flagged.agg(F.coalesce(F.max("_hit"), F.lit(False)).alias("_any"))
    return (
        flagged.join(F.broadcast(any_hit))
        .filter(F.col("_hit") | ~F.col("_any"))
        .drop("_hit", "_any")
    )


def prefix_match(nodes: DataFrame, key: str, prefixes: DataFrame, length: int) -> DataFrame:
    """Full nodes for truncated ids; all prefixes have the same known length, so
    the theta condition is an equi join on the leading characters."""
    return nodes.withColumn("prefix", F.substring(F.col(key), 1, length)).join(
        prefixes.select("prefix").distinct(), "prefix"
    )


def alternate_targets(edges: DataFrame, last_steps: DataFrame) -> DataFrame:
    """Other targets of a chain's last (source, element)."""
    e = edges.select("src", "elem", F.col("tgt").alias("other")).distinct()
    return last_steps.join(e, ["src", "elem"]).filter(F.col("other") != F.col("tgt"))


def action_sequence(composed: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements of an action in order, as rows with properties."""
    return composed.join(elements, "element_id").select(
        "action_id", "order", "element_id", "function_summary"
    )


def action_targets(composed: DataFrame, leads_to: DataFrame) -> DataFrame:
    """Pages an action leads to: the targets of its last element."""
    last = composed.groupBy("action_id").agg(F.max_by("element_id", "order").alias("element_id"))
    return last.join(leads_to.select("element_id", "page_id"), "element_id").select("action_id", "page_id").distinct()


def page_action_ids(has_element: DataFrame, composed: DataFrame) -> DataFrame:
    """Actions offered by a page: those whose first element is on it."""
    first = composed.groupBy("action_id").agg(F.min_by("element_id", "order").alias("element_id"))
    return has_element.join(first, "element_id").select("page_id", "action_id").distinct()


def shortcuts(shortcut_nodes: DataFrame, actions: DataFrame) -> DataFrame:
    return shortcut_nodes.join(actions, "action_id")


def same_element(
    stored: DataFrame, probes: DataFrame, strict: bool = False
) -> DataFrame:
    """Stored element a probe refers to, and the page it leads to.

    ``stored(page_id, element_id, uid, ui_id, bbox, action, action_type, action_arg, target)``,
    ``probes(probe_id, page_id, uid, ui_id, bbox, action, action_type, action_arg)``.  A match by
    (uid, action) goes before one by (ui_id, bbox).  The second accepts any action,
    as observed; ``strict`` also asks for the same scroll direction or input text.
    """
    best = F.min(F.struct("element_id", "target"))
    by_action = stored.groupBy("page_id", "uid", "action").agg(best.alias("first"))
    # One row for each place a probe can match, so a box that many stored elements share is met once and not by each of them.
    box = ["page_id", "ui_id", "bbox"]
    if strict:
        typed = F.col("action_type").isin("input_text", "scroll")
        kind = [F.col("action_type").alias("kind"), typed.alias("typed"), F.when(typed, F.col("action_arg")).alias("arg")]
        by_box = stored.groupBy(*box, *kind).agg(best.alias("second"))
        by_box = by_box.select(*[F.col(c).alias(f"s_{c}") for c in (*box, "kind", "arg")], "second")
        probes = probes.select("*", *kind)
        same_box = (F.col("kind") == F.col("s_kind")) & F.col("arg").eqNullSafe(F.col("s_arg"))
    else:
        by_box = stored.groupBy(*box).agg(best.alias("second")).select(*[F.col(c).alias(f"s_{c}") for c in box], "second")
        same_box = F.lit(True)
    for c in box:
        same_box = same_box & (F.col(c) == F.col(f"s_{c}"))
    met = probes.join(by_action, ["page_id", "uid", "action"], "left").join(by_box, same_box, "left")
    rule = F.when(F.col("first").isNotNull(), 1).when(F.col("second").isNotNull(), 2)
    found = met.select("probe_id", rule.alias("rule"), F.coalesce("first", "second").alias("e")).filter(F.col("rule").isNotNull())
    return found.groupBy("probe_id").agg(F.min(F.struct("rule", "e")).alias("b")).select(
        "probe_id", "b.e.element_id", "b.e.target", "b.rule"
    )


def ordered_lookup(ids: DataFrame, payload: DataFrame) -> DataFrame:
    """Payload of every listed id, in list order, null where unknown.

    ``ids(list_id, ids ARRAY)``, ``payload(page_id, raw_page)``.
    """
    rows = ids.select("list_id", F.posexplode("ids").alias("pos", "page_id"))
    return rows.join(payload, "page_id", "left").select("list_id", "pos", "page_id", "raw_page")


def element_action(params: Column, width: Column, height: Column) -> Column:
    """Executable action of stored JSON parameters: a tap point, a text, or null."""
    kind = F.lower(F.get_json_object(params, "$.action_type"))
    x = F.get_json_object(params, "$.x").cast("double") * width
    y = F.get_json_object(params, "$.y").cast("double") * height
    text = F.get_json_object(params, "$.text")
    return F.when(
        kind.isin("tap", "click"),
        F.struct(F.lit("tap").alias("kind"), x.alias("x"), y.alias("y"), F.lit(None).cast("string").alias("text")),
    ).when(
        kind.isin("text", "type"),
        F.struct(
            F.lit("text").alias("kind"),
            F.lit(None).cast("double").alias("x"),
            F.lit(None).cast("double").alias("y"),
            text.alias("text"),
        ),
    )


def plan_reference(step: Column, operation: Column, raw_id: Column) -> Column:
    """(type, id) a plan step refers to: its token, else operation type and raw id."""
    # The token layout of exported gold paths.
    pattern = r"(?i)_\$(Element|Action)_([a-f0-9\-]+)\$"
    kind = F.regexp_extract(step, pattern, 1)
    return F.struct(
        F.when(kind != "", F.lower(kind)).otherwise(F.lower(operation)).alias("type"),
        F.when(kind != "", F.regexp_extract(step, pattern, 2)).otherwise(raw_id).alias("id"),
    )


def task_trajectory(walk: DataFrame) -> DataFrame:
    """(page, element, action) rows of each task with their order.

    ``walk(task, page_id, element_id, action, ts, order)``; returned with a rank so that the
    order survives a distributed result.
    """

    return ordered_columns(walk, ["task"], ["ts", "order"], [row_number("rank")])


def next_pages(steps: DataFrame) -> DataFrame:
    """Page that follows each page inside a trajectory."""
    return ordered_columns(steps, ["task", "branch"], ["step"], [lead("next_page", "page")])

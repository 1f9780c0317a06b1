"""Search-tree labelling, coverage metrics and training rows.

A tree table has one row per node: ``tree_id, node_id, parent_id, depth, action_list,
visits, value, r``.  All trees are processed together, one join per depth.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import kept
from ..plans.matching import ordered_match
from ..plans.ordered import ordered_columns, row_number, running_sum


def max_depth(tree: DataFrame) -> int:
    """Deepest level: one number from a map-side combined maximum."""
    return tree.agg(F.max("depth")).first()[0] or 0


def _held(df: DataFrame) -> DataFrame:
    """A frame that several steps read: written once, so that its plan runs once and does not grow."""
    return kept(df, "tree")


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ tree values


def with_parent_visits(tree: DataFrame) -> DataFrame:
    parents = tree.select("tree_id", F.col("node_id").alias("parent_id"), F.col("visits").alias("parent_visits"))
    return tree.join(parents, ["tree_id", "parent_id"], "left")


def uct_value(c: float = 1.4, prior: Column | None = None) -> Column:
    """Upper confidence value of a node that carries ``parent_visits``.

    Unvisited nodes are infinite, a root is its mean.  With ``prior`` the
    exploration term is scaled by it.
    """
    mean = F.col("value") / F.col("visits")
    explore = F.lit(float(c)) * F.sqrt(F.log(F.col("parent_visits")) / F.col("visits"))
    if prior is not None:
        explore = explore * prior
    return (
        F.when(F.col("visits") == 0, F.lit(float("inf")))
        .when(F.col("parent_visits").isNull(), mean)
        .otherwise(mean + explore)
    )


def select_child(tree: DataFrame, c: float = 1.4) -> DataFrame:
    """Child to descend to: the first gold one that is not ended, else the best UCT.

    ``tree`` also has ``is_gold`` and ``ended``.  One aggregate per parent, so a
    parent with very many children is combined map-side.
    """
    scored = with_parent_visits(tree).filter(F.col("parent_id").isNotNull() & ~F.col("ended")).withColumn(
        "uct", uct_value(c)
    )
    order = F.struct(
        (~F.col("is_gold")).alias("a"),
        F.when(F.col("is_gold"), F.lit(0.0)).otherwise(-F.col("uct")).alias("b"),
        "node_id",
    )
    return scored.groupBy("tree_id", "parent_id").agg(
        F.min_by("node_id", order).alias("selected"), F.min_by("uct", order).alias("uct")
    )


def backprop_totals(tree: DataFrame, rewards: DataFrame) -> DataFrame:
    """Total reward and visits every node receives from the leaves below it.

    ``rewards(tree_id, node_id, reward)``.  Sums move up one level per pass, so the
    work is one aggregate per depth and a hot ancestor is combined map-side.
    """
    own = rewards.groupBy("tree_id", "node_id").agg(
        F.sum("reward").alias("reward"), F.count(F.lit(1)).alias("n")
    )
    base = _held(
        tree.select("tree_id", "node_id", "parent_id", "depth")
        .join(own, ["tree_id", "node_id"], "left")
        .withColumns(
            {"reward": F.coalesce("reward", F.lit(0)), "n": F.coalesce("n", F.lit(0).cast("long"))}
        )
    )
    levels, below = [], None
    for d in range(max_depth(base), -1, -1):
        level = base.filter(F.col("depth") == d)
        if below is not None:
            up = below.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(
                F.sum("reward").alias("up_reward"), F.sum("n").alias("up_n")
            )
            level = level.join(up, ["tree_id", "node_id"], "left").select(
                "tree_id",
                "node_id",
                "parent_id",
                (F.col("reward") + F.coalesce("up_reward", F.lit(0))).alias("reward"),
                (F.col("n") + F.coalesce("up_n", F.lit(0))).alias("n"),
            )
        else:
            level = level.select("tree_id", "node_id", "parent_id", "reward", "n")
        below = _held(level)
        levels.append(below)
    return _stack(levels).select("tree_id", "node_id", F.col("reward").alias("value"), F.col("n").alias("visits"))


def q_targets(tree: DataFrame, gamma: float = 0.95) -> DataFrame:
    """Value target of every node, from the leaves up.

    A terminal node, or one with r ≥ 1, is 1; a leaf is its r; any other node is
    the larger of its r and ``gamma`` times the mean of its children.
    """
    base = _held(tree.select("tree_id", "node_id", "parent_id", "depth", "r", "terminal"))
    levels, below = [], None
    for d in range(max_depth(base), -1, -1):
        level = base.filter(F.col("depth") == d)
        if below is not None:
            mean = below.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(
                F.avg("q_target").alias("future")
            )
            level = level.join(mean, ["tree_id", "node_id"], "left")
        else:
            level = level.withColumn("future", F.lit(None).cast("double"))
        done = F.coalesce(F.col("terminal"), F.lit(False)) | (F.col("r") >= 1.0)
        q = (
            F.when(done, F.lit(1.0))
            .when(F.col("future").isNull(), F.col("r"))
            .otherwise(F.greatest(F.col("r"), F.lit(gamma) * F.col("future")))
        )
        below = _held(level.select("tree_id", "node_id", "parent_id", q.alias("q_target")))
        levels.append(below)
    return _stack(levels)


def path_totals(tree: DataFrame) -> DataFrame:
    """Sums of value and visits from below the root to every node."""
    base = _held(tree.select("tree_id", "node_id", "parent_id", "depth", "value", "visits"))
    top = base.filter(F.col("depth") == 0).select(
        "tree_id", "node_id", (F.col("value") * 0).alias("path_value"), (F.col("visits") * 0).alias("path_visits")
    )
    levels = [top]
    for d in range(1, max_depth(base) + 1):
        above = levels[-1].withColumnRenamed("node_id", "parent_id")
        level = base.filter(F.col("depth") == d).join(above, ["tree_id", "parent_id"])
        levels.append(
            _held(
                level.select(
                    "tree_id",
                    "node_id",
                    (F.col("path_value") + F.col("value")).alias("path_value"),
                    (F.col("path_visits") + F.col("visits")).alias("path_visits"),
                )
            )
        )
    return _stack(levels)


def topk_leaf_paths(tree: DataFrame, k: int = 5) -> DataFrame:
    """Best ``k`` leaves of each tree by summed value over summed visits of the path."""
    inner = tree.filter(F.col("parent_id").isNotNull()).select("tree_id", F.col("parent_id").alias("node_id"))
    leaves = path_totals(tree).join(inner, ["tree_id", "node_id"], "left_anti")
    score = F.when(F.col("path_visits") > 0, F.col("path_value") / F.col("path_visits")).otherwise(F.lit(0.0))
    return (
        leaves.withColumn("score", score)
        .withColumn(
            "rank", F.expr("row_number() OVER (PARTITION BY tree_id ORDER BY score DESC, node_id)")
        )
        .filter(F.col("rank") <= k)
        .select("tree_id", "node_id", "score", "rank")
    )


# -------------------------------------------------------------------- gold match


def gold_match_len(actions: Column, gold: Column) -> Column:
    """How many gold actions the list covers as an ordered subsequence."""
    return F.aggregate(
        actions,
        F.lit(0),
        lambda i, a: F.when(F.get(gold, i).eqNullSafe(a) & (i < F.size(gold)), i + 1).otherwise(i),
    )


def best_gold_match(actions: Column, golds: Column) -> Column:
    """Best match over several gold paths; 0 without any."""
    return F.coalesce(F.array_max(F.transform(golds, lambda g: gold_match_len(actions, g))), F.lit(0))


def is_terminal(actions: Column, golds: Column) -> Column:
    """Whether some non-empty gold path is fully contained."""
    return F.exists(golds, lambda g: (F.size(g) > 0) & (gold_match_len(actions, g) >= F.size(g)))


def gold_match_rounds(chains: DataFrame, gold: DataFrame) -> DataFrame:
    """:func:`gold_match_len` for chains in long form, however long they are.

    ``chains(chain_id, pos, action)``, ``gold([chain_id,] i, action)`` with ``i`` from 0; a list without
    ``chain_id`` serves all chains.  Positions that hold a gold action go through one ordered
    pass; it never gathers a chain.
    """
    own = "chain_id" in gold.columns
    hits = chains.join(gold, ["chain_id", "action"] if own else ["action"]).select("chain_id", "pos", "i")
    found = ordered_match(hits, "chain_id", "pos", "i")
    return (gold if own else chains).select("chain_id").distinct().join(found, "chain_id", "left").select(
        "chain_id", F.coalesce("matched", F.lit(0).cast("long")).cast("int").alias("matched")
    )


def gold_state(tree: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold progress of every node against its parent.

    ``gold(tree_id, golds ARRAY<ARRAY>)``.  A node that advances the match is gold; a
    full match is terminal with r = 1.
    """
    matched = tree.join(gold, "tree_id", "left").select(
        "tree_id",
        "node_id",
        "parent_id",
        "r",
        best_gold_match(F.col("action_list"), F.coalesce("golds", F.array())).alias("gold_match"),
        F.coalesce(is_terminal(F.col("action_list"), F.col("golds")), F.lit(False)).alias("terminal"),
    )
    parents = matched.select(
        "tree_id", F.col("node_id").alias("parent_id"), F.col("gold_match").alias("parent_match")
    )
    return matched.join(parents, ["tree_id", "parent_id"], "left").select(
        "tree_id",
        "node_id",
        "gold_match",
        "terminal",
        (F.col("terminal") | (F.col("gold_match") > F.coalesce("parent_match", F.lit(0)))).alias("is_gold"),
        F.when(F.col("terminal"), F.lit(1.0)).otherwise(F.col("r")).alias("r"),
    )


def path_covered(actions: Column, gold: Column) -> Column:
    """(full, fraction, count, last matched action) of gold inside a path."""
    n = gold_match_len(actions, gold)
    size = F.size(gold)
    return F.struct(
        (n == size).alias("covered"),
        (n / size).alias("fraction"),
        n.alias("matched"),
        F.when(n > 0, F.get(gold, n - 1)).alias("last_matched"),
    )


def child_matching_prefix(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """Child that continues a target list exactly; the longest, then best mean.

    ``targets(tree_id, node_id, target ARRAY, matched INT)``.
    """
    children = tree.select(
        "tree_id",
        F.col("parent_id").alias("node_id"),
        F.col("node_id").alias("child_id"),
        F.col("action_list").alias("actions"),
        F.when(F.col("visits") > 0, F.col("value") / F.col("visits")).alias("mean"),
    ).filter(F.col("node_id").isNotNull())
    n = F.size("actions")
    fits = (n > F.col("matched")) & (F.col("actions") == F.slice("target", 1, n))
    order = F.struct((-n).alias("n"), (-F.coalesce("mean", F.lit(-1e9))).alias("m"), "child_id")
    return (
        children.join(targets, ["tree_id", "node_id"])
        .filter(fits)
        .groupBy("tree_id", "node_id")
        .agg(F.min_by(F.struct("child_id", n.alias("length")), order).alias("b"))
        .select("tree_id", "node_id", "b.child_id", "b.length")
    )


def tree_coverage(tree: DataFrame, gold: DataFrame) -> DataFrame:
    """Best gold match over all nodes of each tree; ``gold(tree_id, gold ARRAY)``."""
    return (
        tree.join(gold, "tree_id")
        .groupBy("tree_id")
        .agg(
            F.max(gold_match_len(F.col("action_list"), F.col("gold"))).alias("covered_steps"),
            F.max(F.size("gold")).alias("gold_length"),
        )
    )


def coverage_by_task(top_paths: DataFrame, gold: DataFrame, golds: DataFrame) -> DataFrame:
    """Per task, what its ranked paths cover, up to and including the first that counts.

    ``top_paths(tree_id, rank, action_list)``, ``gold(tree_id, gold)``, ``golds(tree_id, golds)``.
    A path counts when it covers the gold path in full or holds the last action of
    some gold path.
    """
    rows = top_paths.join(gold, "tree_id").join(golds, "tree_id")
    cov = path_covered(F.col("action_list"), F.col("gold"))
    hit = F.exists(
        "golds", lambda g: (F.size(g) > 0) & F.array_contains(F.col("action_list"), F.element_at(g, -1))
    )
    rows = rows.select("tree_id", "rank", cov.alias("c"), hit.alias("hit"))
    counts = F.col("c.covered") | F.col("hit")
    stop = rows.filter(counts).groupBy("tree_id").agg(F.min("rank").alias("stop_rank"))
    seen = rows.join(stop, "tree_id", "left").filter(
        F.col("stop_rank").isNull() | (F.col("rank") <= F.col("stop_rank"))
    )
    return seen.groupBy("tree_id").agg(
        F.max("stop_rank").alias("covered_rank"),
        F.min(F.when(F.col("c.covered"), F.col("rank"))).alias("strict_rank"),
        F.when(F.max("stop_rank").isNotNull(), F.lit(1.0)).otherwise(F.max("c.fraction")).alias("covered_rate"),
    )


def coverage_report(by_task: DataFrame, trees: DataFrame) -> DataFrame:
    """Totals over tasks; ``trees`` comes from :func:`tree_coverage`."""
    rows = trees.join(by_task, "tree_id", "left")
    n = F.count(F.lit(1))
    covered, strict = F.count("covered_rank"), F.count("strict_rank")
    return rows.agg(
        n.alias("n_tasks"),
        covered.alias("covered_count"),
        (covered / n).alias("covered_rate"),
        F.coalesce(F.avg("covered_rank"), F.lit(0.0)).alias("mean_rank"),
        strict.alias("strict_count"),
        (strict / n).alias("strict_rate"),
        F.coalesce(F.avg("strict_rank"), F.lit(0.0)).alias("strict_mean_rank"),
        F.avg(F.coalesce("covered_rate", F.lit(0.0))).alias("inner_rate"),
        F.avg(F.col("covered_steps") / F.col("gold_length")).alias("tree_rate"),
    )


def gold_value_gap(tree: DataFrame, gold: DataFrame, c: float = 5.0) -> DataFrame:
    """Mean value, exploration and UCT along the gold branch and of its siblings.

    From the root, each step takes the child that advances the gold match most
    (then the best UCT); the other children of that node are the siblings.
    """
    nodes = _held(tree.select("tree_id", "node_id", "parent_id", "visits", "value", "action_list"))
    children = nodes.select(
        "tree_id",
        F.col("parent_id").alias("at"),
        F.col("node_id").alias("child"),
        F.col("visits").alias("cv"),
        F.col("value").alias("val"),
        "action_list",
    )
    walk = nodes.filter(F.col("parent_id").isNull()).join(gold, "tree_id").select(
        "tree_id", F.col("node_id").alias("at"), F.col("visits").alias("pv"), "gold", F.lit(0).alias("matched")
    )
    steps = []
    q = F.when(F.col("cv") > 0, F.col("val") / F.col("cv")).otherwise(F.lit(0.0))
    u = F.when(
        (F.col("cv") > 0) & (F.col("pv") > 1), F.lit(float(c)) * F.sqrt(F.log("pv") / F.col("cv"))
    ).otherwise(F.lit(0.0))
    while True:
        rows = walk.join(children, ["tree_id", "at"]).select(
            "*", q.alias("q"), u.alias("u"), gold_match_len(F.col("action_list"), F.col("gold")).alias("m")
        )
        ahead = F.col("m") > F.col("matched")
        pick = F.struct((-F.col("m")).alias("m"), (-(F.col("q") + F.col("u"))).alias("v"), "child")
        level = _held(
            rows.groupBy("tree_id", "at").agg(
                F.min_by(F.struct("child", "cv", "q", "u", "m"), F.when(ahead, pick)).alias("b"),
                F.count(F.lit(1)).alias("n"),
                F.sum("q").alias("sq"),
                F.sum(F.col("q") + F.col("u")).alias("suct"),
            ).filter(F.col("b").isNotNull())
        )
        if level.isEmpty():
            break
        others = F.col("n") - 1
        steps.append(
            level.select(
                "tree_id",
                F.col("b.q").alias("gold_q"),
                F.col("b.u").alias("gold_u"),
                (F.col("b.q") + F.col("b.u")).alias("gold_uct"),
                F.when(others > 0, (F.col("sq") - F.col("b.q")) / others).otherwise(0.0).alias("avg_others_q"),
                F.when(others > 0, (F.col("suct") - F.col("b.q") - F.col("b.u")) / others)
                .otherwise(0.0)
                .alias("avg_others_uct"),
            )
        )
        walk = level.join(gold, "tree_id").select(
            "tree_id", F.col("b.child").alias("at"), F.col("b.cv").alias("pv"), "gold", F.col("b.m").alias("matched")
        )
    keys = ("gold_q", "gold_u", "gold_uct", "avg_others_q", "avg_others_uct")
    if not steps:
        return gold.select("tree_id", *[F.lit(0.0).alias(k) for k in keys], F.lit(0).cast("long").alias("steps"))
    means = _stack(steps).groupBy("tree_id").agg(
        *[F.avg(k).alias(k) for k in keys], F.count(F.lit(1)).alias("steps")
    )
    return gold.select("tree_id").join(means, "tree_id", "left").select(
        "tree_id", *[F.coalesce(k, F.lit(0.0)).alias(k) for k in keys], F.coalesce("steps", F.lit(0)).alias("steps")
    )


def failure_diagnostic(tree: DataFrame, gold: DataFrame, top_children: int = 8) -> tuple[DataFrame, DataFrame]:
    """Where each gold path leaves its tree and why, and the best children there.

    ``tree`` also has ``q_target``.  Returns one row per tree, and at most
    ``top_children`` ranked children per tree.
    """
    nodes = _held(
        tree.select("tree_id", "node_id", "parent_id", "visits", "value", "action_list", "q_target")
    )
    at = nodes.filter(F.col("parent_id").isNull()).join(gold, "tree_id").select(
        "tree_id", "node_id", F.col("gold").alias("target"), F.lit(0).alias("matched")
    )
    stopped = []
    while True:
        nxt = child_matching_prefix(nodes, at.filter(F.col("matched") < F.size("target")))
        level = _held(at.join(nxt, ["tree_id", "node_id"], "left"))
        stopped.append(level.filter(F.col("child_id").isNull()).select("tree_id", "node_id", "target", "matched"))
        at = level.filter(F.col("child_id").isNotNull()).select(
            "tree_id", F.col("child_id").alias("node_id"), "target", F.col("length").alias("matched")
        )
        if at.isEmpty():
            break
    end = _stack(stopped)
    mean = F.when(F.col("visits") > 0, F.col("value") / F.col("visits"))
    children = end.join(
        nodes.select(
            "tree_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("child_id"), mean.alias("mean"),
            "q_target", "action_list",
        ),
        ["tree_id", "node_id"],
    )
    by_mean = F.struct((-F.coalesce("mean", F.lit(-1e9))).alias("m"), "child_id")
    by_target = F.struct((-F.col("q_target")).alias("q"), "child_id")
    missing = F.get("target", F.col("matched"))
    correct = F.get("action_list", F.col("matched")) == missing
    summary = children.groupBy("tree_id").agg(
        F.count(F.lit(1)).alias("child_count"),
        F.min_by("child_id", by_mean).alias("best_by_mean"),
        F.min_by("child_id", by_target).alias("best_by_target"),
        F.min(F.when(correct, F.col("child_id"))).alias("correct_child"),
    )
    # The words of a report's reason.
    reason = (
        F.when(F.col("matched") >= F.size("target"), "gold_path_fully_present_in_tree")
        .when(F.col("child_count").isNull(), "tree_leaf_before_gold_complete")
        .otherwise("gold_next_action_not_in_expanded_children")
    )
    report = end.join(summary, "tree_id", "left").select(
        "tree_id",
        reason.alias("reason"),
        F.col("matched").alias("matched_prefix"),
        missing.alias("missing_action"),
        F.col("node_id").alias("divergence_node"),
        F.coalesce("child_count", F.lit(0).cast("long")).alias("child_count"),
        "best_by_mean",
        "best_by_target",
        "correct_child",
        F.size("target").alias("gold_length"),
    )
    ranked = children.withColumn(
        "rank",
        F.expr("row_number() OVER (PARTITION BY tree_id ORDER BY coalesce(mean, -1e9) DESC, child_id)"),
    ).filter(F.col("rank") <= top_children)
    return report, ranked.select("tree_id", "rank", "child_id", "mean", "q_target")


# ------------------------------------------------------------------ sample rows


def history_text(history: Column) -> Column:
    """Executed actions joined with an arrow, or the start marker."""
    # Fixed value: the start marker of an empty history.
    return F.coalesce(F.nullif(F.array_join(history, " -> "), F.lit("")), F.lit("Start of Task"))


def score_prompt(task: Column, page: Column, history: Column, action: Column) -> Column:
    """Prompt text of one candidate action."""
    # The prompt layout the trained models read.
    return F.concat(
        F.lit("<|user|>:\nTask: "), task,
        F.lit("\n\nYou are at: "), page,
        F.lit("\n\nExecuted path: "), history_text(history),
        F.lit("\n\nProposed action:\n<|assistant|>: "), action, F.lit("<end_of_step>"),
    )


def transition_parts(text: Column) -> Column:
    """(from, action, to) of ``<From: a --[action: x]--> To: b>``, null if it is none."""
    # Fixed value: the transition layout.
    pattern = r"(?s)<From:\s*(.*?)\s*--\[action:\s*(.*?)\]-->\s*To:\s*(.*?)>"
    part = [F.trim(F.regexp_extract(text, pattern, i)) for i in (1, 2, 3)]
    return F.when(
        text.rlike(pattern), F.struct(part[0].alias("src"), part[1].alias("action"), part[2].alias("tgt"))
    )


def training_rows(tree: DataFrame, targets: DataFrame, instructions: DataFrame) -> DataFrame:
    """One sample per parent→child edge: prompt text, child target, metadata.

    ``tree`` also has ``page_name`` and ``is_gold``; ``instructions(tree_id, instruction)``.
    """
    parents = tree.select(
        "tree_id",
        F.col("node_id").alias("parent_id"),
        F.col("page_name").alias("caption"),
        F.col("action_list").alias("history"),
    )
    child = tree.filter(F.col("parent_id").isNotNull()).select(
        "tree_id", "node_id", "parent_id", F.try_element_at("action_list", F.lit(-1)).alias("action"), "is_gold"
    )
    return (
        child.join(parents, ["tree_id", "parent_id"])
        .join(targets.select("tree_id", "node_id", "q_target"), ["tree_id", "node_id"])
        .join(instructions, "tree_id")
        .select(
            score_prompt(F.col("instruction"), F.col("caption"), F.col("history"), F.col("action")).alias("text"),
            F.col("q_target").alias("label"),
            F.struct(
                F.col("parent_id").alias("page_id"), F.col("action").alias("action_raw"), "is_gold"
            ).alias("metadata"),
        )
    )


def score_frontier(frontier: DataFrame, score: Callable, columns: list[str]) -> DataFrame:
    """Add a ``score`` to every candidate with a plug-in scorer over Arrow batches."""
    from ..functions.udfs import scorer

    fields = frontier.select(*columns).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    run, schema = scorer(score, ddl)
    return frontier.select(*columns).mapInPandas(run, schema)


# --------------------------------------------------------------- rounds, samples


def round_batch(tasks: DataFrame, key: str, start: int, size: int) -> DataFrame:
    """Round-robin slice of the ordered task list, wrapping around.

    A task repeats when ``size`` exceeds the number of tasks.
    """
    indexed = ordered_columns(tasks, [], [key], [row_number("_i")])
    n = tasks.count()
    spark = tasks.sparkSession
    slots = spark.range(size).select(
        F.col("id").alias("slot"), (F.pmod(F.col("id") + F.lit(start), F.lit(n)) + 1).alias("_i")
    )
    return slots.join(indexed, "_i").drop("_i")


def hash_fraction(key: Column, seed: int) -> Column:
    """Stable number in 0 … 2³²−1 from a key and a seed."""
    text = F.concat(key.cast("string"), F.lit(f"_{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_split(rows: DataFrame, key: str, train: float = 0.95, seed: int = 42) -> DataFrame:
    """Stable train/test split by key; independent of partitioning and order."""
    cut = int(train * 2**32)
    return rows.withColumn(
        "split", F.when(hash_fraction(F.col(key), seed) < cut, "train").otherwise("test")
    )


def label_stats(rows: DataFrame, label: str) -> DataFrame:
    """n, positives, mean, population deviation, minimum and maximum."""
    c = F.col(label)
    return rows.agg(
        F.count(c).alias("n"),
        F.count_if(c > 0).alias("positives"),
        F.avg(c).alias("mean"),
        F.stddev_pop(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    )


def balanced_sample(rows: DataFrame, key: str, label: str, n: int = 40, seed: int = 42) -> DataFrame:
    """Sample of ``n``: half positive if there are any, the rest negative, topped up.

    Rows are taken in the order of a stable hash; only the first ``n`` of each class
    can be chosen, so each task keeps at most that many.
    """
    positive = F.col(label) > 0
    totals = rows.agg(
        F.count_if(positive).alias("n_pos"), F.count_if(~positive).alias("n_neg")
    )
    pos_quota = F.when(
        F.col("n_pos") > 0,
        F.least(F.col("n_pos"), F.greatest(F.lit(1), F.floor(F.least(F.lit(n), F.col("n_pos") + F.col("n_neg")) / 2))),
    ).otherwise(0)
    neg_quota = F.least(F.col("n_neg"), F.lit(n) - F.col("pos_quota"))
    quotas = totals.withColumn("pos_quota", pos_quota).withColumn("neg_quota", neg_quota).withColumn(
        "pos_quota", F.greatest("pos_quota", F.least(F.col("n_pos"), F.lit(n) - F.col("neg_quota")))
    )
    ranked = (
        rows.withColumn("_pos", positive)
        .withColumn("_h", hash_fraction(F.col(key), seed))
        .withColumn("_rank", F.expr(f"row_number() OVER (PARTITION BY _pos ORDER BY _h, `{key}`)"))
        .filter(F.col("_rank") <= n)
    )
    # ``quotas`` is one row.
    quota = F.when(F.col("_pos"), F.col("pos_quota")).otherwise(F.col("neg_quota"))
    return ranked.join(F.broadcast(quotas)).filter(F.col("_rank") <= quota).select(*rows.columns)


def regression_metrics(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    d = F.col(prediction) - F.col(label)
    return rows.agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"))


def pair_weight(pos: Column, neg: Column) -> Column:
    """1/(pos·neg), or 1/(pos+neg) when either is zero."""
    return F.when((pos == 0) | (neg == 0), F.lit(1.0) / F.nullif(pos + neg, F.lit(0))).otherwise(
        F.lit(1.0) / F.nullif(pos * neg, F.lit(0))
    )


def pair_accuracy(rows: DataFrame, chosen: str, rejected: str) -> DataFrame:
    return rows.agg(F.avg((F.col(chosen) > F.col(rejected)).cast("double")).alias("accuracy"))


def cumulative_pool(samples: DataFrame, upto: int) -> DataFrame:
    """Training pool of a round: all samples of that round and before."""
    return samples.filter(F.col("round") <= upto)


def pool_sizes(samples: DataFrame) -> DataFrame:
    """Size of every round's cumulative pool, from one count per round."""
    counts = samples.groupBy("round").agg(F.count(F.lit(1)).alias("n_new"))
    return ordered_columns(counts, [], ["round"], [running_sum("n_pool", "n_new")])

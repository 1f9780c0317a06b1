"""Graph fold, paths and tree operators on small hand-made inputs."""

from pyspark.sql import functions as F
from trajgraph.operators import graph as G
from trajgraph.operators import paths as P
from trajgraph.operators import training as T


def test_fold_drops_noops_and_carries_the_page(spark, as_rows):
    steps = spark.createDataFrame(
        [
            ("t", "b1", 0, "h1", "h2", "tap", "g"),
            ("t", "b1", 1, "h2", "h2", "wait", "g"),  # nothing changed
            ("t", "b1", 2, "h2b", "h3", "tap", "g"),  # the walk still stands on h2
            ("t", "b1", 3, "h3", None, "done", "g"),  # no after-screen
            ("t", "b2", 0, "h1", "h2", "tap", "g2"),
        ],
        "task string, branch string, step int, before_hash string, after_hash string, action string, goal string",
    )
    g = G.fold_trajectories(steps)
    assert as_rows(g["pages"].select("page_id", "is_placeholder")) == [("h1", False), ("h2", False), ("h3", True)]
    assert g["elements"].count() == 2 and g["has_element"].count() == 2
    assert as_rows(g["page_steps"]) == [("h1", "t", 0), ("h2", "t", 1), ("h3", "t", 2)]
    assert as_rows(g["page_goals"].select("node_id", "goal")) == [
        ("h1", "g"), ("h1", "g2"), ("h2", "g"), ("h2", "g2"), ("h3", "g"),
    ]
    same = spark.createDataFrame([("h3", "h1")], "hash string, page_id string")
    assert as_rows(G.fold_trajectories(steps, same)["pages"].select("page_id")) == [("h1",), ("h2",)]


def test_fold_continues_branches(spark, as_rows):
    steps = spark.createDataFrame(
        [
            ("t", "", 0, "h1", "h2", "tap", False),
            ("t", "", 1, "h2", "h3", "tap", False),
            ("t", "a", 0, "other", "h4", "tap", False),  # starts where the branch above ended
            ("t", "a/b", 0, "x", "h5", "tap", True),
            ("t", "a/b", 1, "h5", "h1", "back", True),  # a leaf's last page is its own
            ("t", "c/d", 0, "y", "h6", "tap", True),  # its folder c has no steps
        ],
        "task string, branch string, step int, before_hash string, after_hash string, action string, is_leaf boolean",
    ).withColumn("goal", F.lit("g"))
    g = G.fold_trajectories(steps)
    assert as_rows(g["page_steps"]) == [
        ("h1", "t", 0), ("h2", "t", 1), ("h3", "t", 2), ("h4", "t", 3), ("h5", "t", 4), ("leaf/t/a/b", "t", 5), ("leaf/t/c/d", "t", 3),
    ]
    assert {r.page_id for r in g["pages"].filter("is_placeholder").collect()} == {"leaf/t/a/b", "leaf/t/c/d"}


def test_paths_need_consecutive_steps(spark, as_rows):
    edges = spark.createDataFrame(
        [("t", 0, "a", "e1", "b"), ("t", 1, "b", "e2", "c"), ("t", 1, "b", "e3", "d"), ("t", 3, "c", "e4", "x")],
        "task string, step int, src string, elem string, tgt string",
    )
    starts = spark.createDataFrame([("t", "a", 0), ("t", "zz", 0)], "task string, page_id string, step int")
    got = as_rows(P.task_paths(starts, edges).select("path_id", "leaf_page"))
    assert got == [("P:a->E:e1->P:b->E:e2->P:c", "c"), ("P:a->E:e1->P:b->E:e3->P:d", "d")]
    both = starts.union(spark.createDataFrame([("t", "b", 1), ("t", "c", 3)], starts.schema))
    assert P.task_paths(both, edges).count() == 5


def test_chains_stop_at_cycles(spark, as_rows):
    e = spark.createDataFrame(
        [("g", "a", "1", "b"), ("g", "b", "2", "a"), ("g", "b", "3", "c")], "graph string, src string, elem string, tgt string"
    )
    roots = spark.createDataFrame([("g", "a")], "graph string, page_id string")
    assert as_rows(P.all_chains(roots, e).select("path_id")) == [("P:a->E:1->P:b->E:3->P:c",)]


def test_forced_walk_is_bounded_and_never_returns(spark, as_rows):
    line = [("g", f"p{i:02d}", f"e{i}", f"p{i + 1:02d}") for i in range(14)] + [("g", "x", "s", "x"), ("h", "a", "1", "b"), ("h", "b", "2", "a")]
    e = spark.createDataFrame(line, "graph string, src string, elem string, tgt string")
    got = {(r.graph, r.start_page): (r.end_page, len(r.forced)) for r in P.forced_chains(e).collect()}
    assert got[("g", "p00")] == ("p10", 10)
    assert got[("g", "p09")] == ("p14", 5)
    assert got[("h", "a")] == ("b", 1) and ("g", "x") not in got


def test_rewrite_prefers_long_groups(spark, as_rows):
    steps = spark.createDataFrame(
        [("p", i, f"s{i}", e, f"s{i + 1}") for i, e in enumerate("abcxab")], "path_id string, pos int, src string, elem string, tgt string"
    )
    members = spark.createDataFrame(
        [("A", "a"), ("A", "b"), ("B", "a"), ("B", "b"), ("B", "c"), ("C", "q")], "action_id string, element_id string"
    )
    match = P.matching_groups(steps.select("path_id", F.col("elem").alias("element_id")), members)
    assert sorted(r.action_id for r in match.collect()) == ["A", "B"]
    as_set = lambda df: {tuple(r) for r in df.select("path_id", "action_id", "element_id").collect()}
    assert as_set(P.choose_groups(match, members)) == as_set(P.choose_groups(match, members, folded=0))
    out = P.rewrite_with_groups(steps, P.choose_groups(match, members)).orderBy("run").collect()
    assert [(r.elem, r.src, r.tgt, r.n_steps) for r in out] == [("B", "s0", "s3", 3), ("x", "s3", "s4", 1), ("B", "s4", "s6", 2)]


def test_action_key_ignores_the_last_target(spark):
    df = spark.createDataFrame([(["a,b,c", "c,d,e"],), (["a,b,c", "c,d,z"],), (["a,b,x", "c,d,e"],), ([],)], "c array<string>")
    a, b, c, d = [r[0] for r in df.select(G.action_key(F.col("c"))).collect()]
    assert a == b != c and d is None


def tree(spark):
    return spark.createDataFrame(
        [
            ("t", "r", None, 0, [], 4, 2.0, 0.0, False), ("t", "a", "r", 1, ["a"], 3, 1.5, 0.0, False),
            ("t", "b", "r", 1, ["b"], 0, 0.0, 0.0, False), ("t", "a1", "a", 2, ["a", "x"], 1, 1.0, 0.2, True),
            ("t", "a2", "a", 2, ["a", "y"], 1, 0.5, 0.0, False),
        ],
        "tree_id string, node_id string, parent_id string, depth int, action_list array<string>, visits long, value double, r double, terminal boolean",
    )


def test_targets_of_a_small_tree(spark):
    q = {r.node_id: r.q_target for r in T.q_targets(tree(spark)).collect()}
    assert q["a1"] == 1.0 and q["a2"] == 0.0 and q["b"] == 0.0
    assert abs(q["a"] - 0.475) < 1e-12 and abs(q["r"] - 0.95 * 0.475 / 2) < 1e-12


def test_unvisited_child_is_infinite_and_selected(spark):
    t = tree(spark).withColumns({"is_gold": F.lit(False), "ended": F.lit(False)})
    sel = {r.parent_id: r.selected for r in T.select_child(t).collect()}
    assert sel == {"r": "b", "a": "a1"}
    gold = t.withColumn("is_gold", F.col("node_id") == "a").withColumn("ended", F.col("node_id") == "a1")
    assert {r.parent_id: r.selected for r in T.select_child(gold).collect()} == {"r": "a", "a": "a2"}


def test_gold_matching(spark):
    df = spark.createDataFrame([(["a", "x", "b"], ["a", "b", "c"]), (["c"], ["a"]), ([], ["a"]), (["a", "a"], ["a"])], "p array<string>, g array<string>")
    got = [tuple(r[0]) for r in df.select(T.path_covered(F.col("p"), F.col("g"))).collect()]
    assert got == [(False, 2 / 3, 2, "b"), (False, 0.0, 0, None), (False, 0.0, 0, None), (True, 1.0, 1, "a")]


def test_failure_reasons(spark):
    t = T.q_targets(tree(spark)).drop("parent_id").join(tree(spark), ["tree_id", "node_id"])
    reason = {}
    for name, path in {"present": ["a", "x"], "leaf": ["b", "z"], "missing": ["a", "q"]}.items():
        gold = spark.createDataFrame([("t", path)], "tree_id string, gold array<string>")
        report, top = T.failure_diagnostic(t, gold, 1)
        row = report.first()
        reason[name] = (row.reason, row.matched_prefix, row.child_count, top.count())
    assert reason == {
        "present": ("gold_path_fully_present_in_tree", 2, 0, 0),
        "leaf": ("tree_leaf_before_gold_complete", 1, 0, 0),
        "missing": ("gold_next_action_not_in_expanded_children", 1, 2, 1),
    }


def test_balanced_sample_quotas(spark):
    for n_pos, n_neg, n, want in [(0, 50, 40, (0, 40)), (5, 50, 40, (5, 35)), (50, 50, 40, (20, 20)), (50, 3, 40, (37, 3)), (3, 2, 40, (3, 2))]:
        df = spark.range(n_pos + n_neg).withColumn("label", (F.col("id") < n_pos).cast("int"))
        got = T.balanced_sample(df, "id", "label", n).agg(F.sum("label"), F.count(F.lit(1))).first()
        assert (got[0] or 0, got[1] - (got[0] or 0)) == want


def test_round_batch_wraps(spark):
    df = spark.createDataFrame([("c",), ("a",), ("b",)], "task string")
    got = [r.task for r in T.round_batch(df, "task", 4, 5).orderBy("slot").collect()]
    assert got == ["b", "c", "a", "b", "c"]


def test_groups_are_chosen_alike_by_fold_and_rounds(spark):
    import random

    rng = random.Random(6)
    members = {f"A{i:02d}": set(rng.sample("abcdefghijklmnop", rng.randint(1, 5))) for i in range(40)}
    matches = [(f"p{p}", a, len(members[a])) for p in range(6) for a in rng.sample(sorted(members), 25)]
    want = set()
    for p in {m[0] for m in matches}:
        taken = set()
        for _, a in sorted((-n, a) for q, a, n in matches if q == p):
            if not members[a] & taken:
                taken |= members[a]
                want |= {(p, a, e) for e in members[a]}
    m = spark.createDataFrame(matches, "path_id string, action_id string, group_size long")
    e = spark.createDataFrame([(a, x) for a, xs in members.items() for x in xs], "action_id string, element_id string")
    for folded in (64, 0):
        assert {tuple(r) for r in P.choose_groups(m, e, folded).select("path_id", "action_id", "element_id").collect()} == want

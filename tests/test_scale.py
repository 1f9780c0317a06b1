"""Operators whose work was once in proportion to pairs of rows."""

import itertools
import random

import pytest
from plan_rows import node_rows
from pyspark.sql import functions as F
from trajgraph.operators import graph as G
from trajgraph.operators import paths as P
from trajgraph.operators import search as S

STORED = "page_id string, element_id long, uid string, ui_id string, bbox string, action string, action_type string, action_arg string, target string"
PROBES = "probe_id long, page_id string, uid string, ui_id string, bbox string, action string, action_type string, action_arg string"


def plain_match(stored, probes, strict):
    best = {}
    for p in probes:
        for s in stored:
            if p[1] is None or p[1] != s[0]:
                continue
            rules = []
            if None not in (p[2], p[5]) and (p[2], p[5]) == (s[2], s[5]):
                rules.append(1)
            if None not in (p[3], p[4]) and (p[3], p[4]) == (s[3], s[4]):
                typed = p[6] in ("input_text", "scroll")
                if not strict or (p[6] is not None and p[6] == s[6] and (not typed or p[7] == s[7])):
                    rules.append(2)
            for rule in rules:
                key = (rule, s[1], (s[8] is not None, s[8] or ""))
                best[p[0]] = min(best.get(p[0], key), key)
    return sorted((i, b[1], b[2][1] if b[2][0] else None, b[0]) for i, b in best.items())


@pytest.mark.parametrize("strict", [False, True])
def test_same_element_meets_a_box_once(spark, strict):
    rng = random.Random(4)
    pick = lambda *xs: rng.choice(xs)
    stored = [
        (pick("p", "q", None), i % 90, pick("u", "v", None), "ui", pick("b", "c"), pick("tap", "swipe"), pick("input_text", "scroll", "tap", None), pick("x", "y", None), pick("t", None))
        for i in range(300)
    ]
    probes = [
        (i % 250, pick("p", "q", "r", None), pick("u", "w", None), "ui", pick("b", "d"), pick("tap", "other"), pick("input_text", "scroll", "tap", None), pick("x", "y", None))
        for i in range(300)
    ]
    out = G.same_element(spark.createDataFrame(stored, STORED), spark.createDataFrame(probes, PROBES), strict)
    got = sorted((r.probe_id, r.element_id, r.target, r.rule) for r in out.collect())
    assert got == plain_match(stored, probes, strict)
    # Probes and not pairs of probes and stored elements.
    assert max(node_rows(out, "Join")) <= 300


def plain_moves(frontier, has, leads, pages, page_tasks, element_tasks):
    pt, et = set(page_tasks), set(element_tasks)
    return sorted(
        (n, e, t)
        for (n, task, page, parent, expanded), (p, e), (f, t), (q, summary) in itertools.product(frontier, has, leads, pages)
        if p == page and f == e and q == t and summary is not None and e not in expanded and t != parent
        and ((page, task) not in pt or (e, task) not in et or (t, task) in pt)
    )


def test_page_actions_shuffle_no_moves(spark):
    rng = random.Random(7)
    page, elem, task = (lambda: f"p{rng.randrange(6)}"), (lambda: f"e{rng.randrange(12)}"), (lambda: rng.choice(["t", "u", "v", None]))
    frontier = [(f"n{i}", task(), page(), rng.choice([page(), None]), [elem()]) for i in range(200)]
    has = sorted({(page(), elem()) for _ in range(40)}) + [("p0", "e0")] * 2
    leads = sorted({(elem(), page()) for _ in range(25)})
    pages = [(f"p{i}", None if i == 2 else f"page {i}") for i in range(6)]
    page_tasks = [(page(), task()) for _ in range(9)]
    element_tasks = [(elem(), task()) for _ in range(14)]
    frames = [
        spark.createDataFrame(rows, schema)
        for rows, schema in (
            (frontier, "node_id string, task string, page_id string, parent_page string, expanded array<string>"),
            (has, "page_id string, element_id string"), (leads, "element_id string, page_id string"),
            (pages, "page_id string, function_summary string"), (page_tasks, "page_id string, task string"), (element_tasks, "element_id string, task string"),
        )
    ]
    # Small tables would be broadcast and nothing shuffled at all.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = P.page_actions(*frames)
        got = sorted((r.node_id, r.element_id, r.target) for r in out.collect())
        shuffled = max(node_rows(out, "Exchange", "shuffleRecordsWritten"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    known = lambda rows: [r for r in rows if r[1] is not None]
    assert got == plain_moves(frontier, has, leads, pages, known(page_tasks), known(element_tasks))
    assert len(got) > 2 * len(frontier)
    assert shuffled <= len(frontier)


def test_beams_send_the_best_steps(spark, monkeypatch):
    rng = random.Random(11)
    # Every page leads to all others by several moves; weights are whole, or fractions that add up alike.
    for weight in (lambda: float(rng.randint(1, 9)), lambda: rng.choice([0.1, 0.2, 1e-17, 2e-17, 1.0])):
        steps = [(f"p{a:02d}", f"m{a:02d}-{b:02d}-{c}", [f"p{b:02d}"], f"p{b:02d}", weight()) for a in range(30) for b in range(30) if a != b for c in range(4)]
        starts = [(f"t{i}", f"p{i:02d}") for i in range(30)] + [("t0", "p07")]
        df = spark.createDataFrame(starts, "task string, page_id string")
        frame = spark.createDataFrame(steps, "src string, path string, pages array<string>, tgt string, step_score double")
        by_levels, routed = S._by_levels, []

        def watched(starts, *more):
            routed.append(starts.select("task").distinct().count())
            return by_levels(starts, *more)

        monkeypatch.setattr(S, "_by_levels", watched)
        want = sorted(tuple(r) for r in S.beam_paths(df, frame, beam=3, depth=10).collect())
        assert not routed
        # Most searches end among the steps sent; with fewer steps, or fractions, some tasks go on with all steps.
        for most, ended in ((300_000, True), (75_000, False)):
            routed.clear()
            assert sorted(tuple(r) for r in S.beam_paths(df, frame, beam=3, depth=10, max_broadcast_bytes=most).collect()) == want
            if ended:
                assert sum(routed) < 30
        monkeypatch.setattr(S, "_by_levels", by_levels)


def unsized(df):
    """``df`` after an aggregate over far more rows, so that its size is not known beforehand."""
    many = df.sparkSession.range(3_000_000).select((F.col("id") % 2).alias("_i"))
    return df.crossJoin(F.broadcast(many.limit(1).select("_i"))).unionByName(
        many.filter("_i > 1").select("_i", *[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
    ).drop("_i").distinct()


def first_plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def plain_edges(has, leads, pages, elements):
    at = set(pages)
    return sorted(
        {
            (t, s, p, e, q)
            for (e, t, s), (p, f), (g, q) in itertools.product(elements, has, leads)
            if None not in (e, t, s) and e == f == g and (p, t, s) in at and (q, t, s + 1) in at
        }
    )


def test_graph_of_task_steps_is_not_shuffled(spark):
    rng = random.Random(9)
    page, elem = lambda: rng.choice(["a", "b", "c", None]), lambda: rng.choice(["x", "y", "z", None])
    task, step = lambda: rng.choice(["t", "u", None]), lambda: rng.choice([0, 1, 2, None])
    has, leads = [(page(), elem()) for _ in range(12)], [(elem(), page()) for _ in range(12)]
    pages, elements = [(page(), task(), step()) for _ in range(30)], [(elem(), task(), step()) for _ in range(30)]
    make = spark.createDataFrame
    frames = [
        make(has, "page_id string, element_id string"), make(leads, "element_id string, page_id string"),
        make(pages, "page_id string, task string, step long"), make(elements, "element_id string, task string, step long"),
    ]
    known = lambda rows: [r for r in rows if None not in r]
    want = plain_edges(known(has), known(leads), known(pages), elements)
    assert want and sorted(tuple(r) for r in P.task_step_edges(*frames).collect()) == want
    out = P.task_step_edges(*[unsized(f) for f in frames])
    assert sorted(tuple(r) for r in out.collect()) == want
    # Only the looks at the page steps shuffle the steps; the graph, once stored, is small.
    plan = first_plan(out)
    assert plan.count("SortMergeJoin") == 2 and plan.count("BroadcastHashJoin") == 2


def test_enriched_steps_are_not_shuffled(spark):
    steps = spark.createDataFrame(
        [("k", 0, "a", "x", "b"), ("k", 1, "b", "y", "gone"), ("l", 0, None, "none", "a")], "path_id string, pos int, src string, elem string, tgt string"
    )
    pages = spark.createDataFrame([("a", "A", "ga"), ("b", None, "")], "page_id string, function_summary string, goal string")
    elements = spark.createDataFrame([("x", "X", None), ("y", "Y", "gy")], "element_id string, function_summary string, goal string")
    out = P.enrich_steps(steps, unsized(pages), unsized(elements))
    cols = ["path_id", "pos", "src_summary", "src_goal", "elem_summary", "elem_goal", "tgt_summary", "tgt_goal"]
    assert sorted(tuple(r) for r in out.select(cols).collect()) == [
        ("k", 0, "A", "ga", "X", None, None, ""), ("k", 1, None, "", "Y", "gy", None, None), ("l", 0, None, None, None, None, "A", "ga"),
    ]
    plan = first_plan(out)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 3


def test_a_level_of_paths_is_stored_once(spark, monkeypatch):
    edges = [(t, s, f"p{s}", f"e{s}{i}", f"p{s + 1}") for t in "tu" for s in range(4) for i in range(2)]
    starts = spark.createDataFrame([("t", "p0", 0), ("u", "p0", 0), ("v", "p0", 0), (None, "p0", 0)], "task string, page_id string, step int")
    monkeypatch.delattr(P, "durable")  # rows kept on disk for a checkpoint are stored twice
    found = P.task_paths(starts, spark.createDataFrame(edges, "task string, step int, src string, elem string, tgt string")).collect()
    want = sorted(
        (t, "->".join(["P:p0"] + [f"E:e{s}{i}->P:p{s + 1}" for s, i in enumerate(picks)]))
        for t in "tu" for picks in itertools.product(range(2), repeat=4)
    )
    assert sorted((r.task, r.path_id) for r in found) == want
    assert all([tuple(x) for x in r.triplets] == [(f"p{s}", x.elem, f"p{s + 1}") for s, x in enumerate(r.triplets)] for r in found)

"""Forced walks, collapsed steps and beams against plain searches."""

import random

import pytest
from trajgraph.operators import search as S

MOVES = "graph string, src string, move string, tgt string, weight double"


def some_moves(seed, n=60):
    """A sparse graph, so that long stretches of pages have a single choice; weights are whole and often equal."""
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        for c in range(rng.choice([0, 1, 1, 1, 1, 2, 3])):
            t = (i + 1) % n if rng.random() < 0.7 else rng.randrange(n)
            out[(f"p{i:02d}", f"m{i:02d}{c}")] = (f"p{t:02d}", float(rng.randint(1, 3)))
    return [("g", s, m, t, w) for (s, m), (t, w) in out.items()]


def plain_walk(moves, start, most):
    by = {}
    for _, s, m, t, w in moves:
        by.setdefault(s, []).append((m, t, w))
    forced, pages, weight, at, stop = [], [], 0.0, start, "length"
    for _ in range(most):
        if len(by.get(at, [])) != 1:
            stop = "branch" if at in by else "dead"
            break
        m, t, w = by[at][0]
        if t == start or t in pages:
            stop = "loop"
            break
        forced, pages, weight, at = forced + [m], pages + [t], weight + w, t
    else:
        stop = "length" if at in by else "dead"
    return (at, forced, pages, weight, stop) if forced else None


@pytest.mark.parametrize("seed, most", [(1, 10), (2, 10), (3, 3), (4, 1), (5, 16)])
def test_forced_walks(spark, seed, most):
    moves = some_moves(seed)
    got = {r.start_page: (r.end_page, r.forced, r.pages, r.weight, r.stop) for r in S.forced_walks(spark.createDataFrame(moves, MOVES), most).collect()}
    starts = {s for _, s, *_ in moves if sum(x[1] == s for x in moves) == 1}
    want = {s: plain_walk(moves, s, most) for s in starts}
    assert got == {s: w for s, w in want.items() if w}
    assert len({w[4] for w in want.values() if w}) > 1


def test_choices_count_elements_and_actions(spark):
    from trajgraph.operators import paths as P

    edges = spark.createDataFrame([("g", "a", "e", "b"), ("g", "b", "f", "c")], "graph string, src string, elem string, tgt string")
    actions = spark.createDataFrame([("g", "b", "x+y", "d")], "graph string, src string, action string, tgt string")
    ends = lambda df: {r.start_page: r.end_page for r in df.collect()}
    assert ends(P.forced_chains(edges)) == {"a": "c", "b": "c"}
    assert ends(P.forced_chains(edges, actions)) == {"a": "b"}
    assert ends(P.forced_chains(edges.filter("src = 'a'"), actions)) == {"a": "d", "b": "d"}


def plain_steps(moves):
    out = []
    for s in {m[1] for m in moves}:
        own = [m for m in moves if m[1] == s]
        walk = plain_walk(moves, s, 10) if len(own) == 1 else (s, [], [], 0.0, "branch")
        if walk is None:
            continue
        at, forced, pages, weight, stop = walk
        if stop in ("branch", "length"):
            out += [(s, " ".join([*forced, m]), [*pages, t], t, weight + w) for _, a, m, t, w in moves if a == at and t not in (s, *pages)]
        else:
            out.append((s, " ".join(forced), pages, at, weight))
    return out


def plain_beam(steps, starts, beam, depth):
    front, out = [("", 0.0, s, {s}) for s in starts], []
    for d in range(1, depth + 1):
        grown = [((p + " " + x).strip(), v + w, t, been | set(q)) for p, v, at, been in front for s, x, q, t, w in steps if s == at and not been & set(q)]
        front = sorted(grown, key=lambda g: (-g[1], g[0]))[:beam]
        out += [(d, i, g[0], g[1]) for i, g in enumerate(front, 1)]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_beams_on_both_routes(spark, seed):
    moves = some_moves(seed)
    rng = random.Random(seed)
    starts = [(f"t{i}", f"p{rng.randrange(60):02d}") for i in range(6)] + [("t0", "p01"), ("t1", "nowhere")]
    steps = S.collapsed_steps(spark.createDataFrame(moves, MOVES))
    want_steps = sorted(plain_steps(moves))
    assert sorted((r.src, r.path, r.pages, r.tgt, r.step_score) for r in steps.collect()) == want_steps
    df = spark.createDataFrame(starts, "task string, page_id string")
    want = sorted((t, *r) for t in {t for t, _ in starts} for r in plain_beam(want_steps, sorted({p for u, p in starts if u == t}), 3, 12))
    for most in (10**9, 0):
        got = S.beam_paths(df, steps, beam=3, depth=12, max_broadcast_bytes=most)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert S.beam_paths(df.limit(0), steps).count() == 0 and S.beam_paths(df, steps.limit(0)).count() == 0

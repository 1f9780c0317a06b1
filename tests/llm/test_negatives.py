import math

import numpy as np
import pytest
from trajgraph.llm.negatives import Query, dump, encode, mine, prepare, rotation

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_anchor, scale=256):
    """Every pair scored with Python's integers."""
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        one = (tuple(math.floor(scale * float(np.float32(x))) for x in v), label)
        kept[i] = min(kept.get(i, one), one)
    out = set()
    for a, (v, label) in kept.items():
        if not is_anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (w, _) in kept.items() if i != a and len(w) == len(v)}
        best = lambda ids: sorted(ids, key=lambda i: (-score[i], i))[:5]
        for p in best(i for i in score if kept[i][1] == label):
            fit = [i for i in score if kept[i][1] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out |= {(a, p, n, i, score[p], score[i]) for n, i in enumerate(best(fit), 1)}
    return out


def run(spark, rows, is_anchor="id % 3 = 0", shard_rows=16):
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    return [tuple(r) for r in mine(df, F.expr(is_anchor), shard_rows=shard_rows).collect()]


def clustered(seed, n, width):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, width))
    kind = rng.integers(0, 6, n)
    v = centres[kind] + rng.standard_normal((n, width)) * rng.choice([0.01, 0.3, 1.0], (n, 1))
    return [(i, [float(x) for x in v[i] / np.linalg.norm(v[i])], int(kind[i] % 3 if i % 4 else rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("width", [1, 7, 64, 70])
def test_against_every_pair(spark, width):
    rows = clustered(width, 150, width)
    found = run(spark, rows)
    assert len(found) == len(set(found)) and set(found) == brute(rows, lambda i: i % 3 == 0)
    assert width == 1 or found


def test_ties_repeats_nulls_and_widths(spark):
    one = [0.5] * 8
    rows = [(i, one, i % 2) for i in range(40)]
    rows += [(50, None, 1), (51, [], 1), (52, [0.1] * 7 + [None], 0), (53, [float("nan")] * 8, 0), (54, [float("inf")] * 8, 1)]
    rows += [(55, one, None), (None, one, 0), (57, [0.2] * 3, 0), (60, [0.2] * 3, 0), (61, [0.19] * 3, 1)]
    rows += [(3, one, 1), (3, [0.4] * 8, 0), (63, [0.0] * 8, 0), (66, [-0.5] * 8, 1)]
    assert set(run(spark, rows)) == brute(rows, lambda i: i % 3 == 0)
    assert run(spark, rows[40:47]) == []
    assert run(spark, []) == []


def test_large_numbers(spark):
    rows = [(i, [float(2.0 ** (i % 23)), -1.0, float(i)], i % 2) for i in range(60)]
    assert set(run(spark, rows)) == brute(rows, lambda i: i % 3 == 0)


def test_extra_columns(spark):
    rows = clustered(1, 60, 8)
    df = spark.createDataFrame([(*r, "a", 1.5) for r in rows], SCHEMA + ", id string, score double")
    from pyspark.sql import functions as F

    assert {tuple(r) for r in mine(df, F.expr("id % 3 = 0")).collect()} == brute(rows, lambda i: i % 3 == 0)


@pytest.mark.parametrize("seed", range(3))
def test_bounds_hold_and_filter(seed):
    rows = clustered(seed, 400, 64)
    vectors = np.array([[math.floor(256 * x) for x in v] for _, v, _ in rows], np.int64)
    ids, labels = np.arange(400), np.array([label for *_, label in rows])
    shard = prepare(dump(**encode(ids, labels, vectors)))
    turn = rotation(64)
    narrow = 0
    for q in vectors[::20]:
        low, high = Query(q, turn).bounds(shard, slice(0, 400))
        exact = shard["vectors"] @ q
        assert (low <= exact).all() and (exact <= high).all()
        narrow += int((high >= np.sort(exact)[-5]).sum())
    assert narrow < 0.3 * 400 * 20

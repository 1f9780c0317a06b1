import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from trajgraph.llm import kdtree
from trajgraph.llm.kdtree import build_tree, search_block, top_k


def brute(rows, asked, k):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(256 * x) for x in v]
            fine[i] = min(whole, fine.get(i, whole))
    out = []
    for q in {i for i, _ in asked} & set(fine):
        scores = [(-sum(a * b for a, b in zip(fine[q], v)), i) for i, v in fine.items() if i != q and len(v) == len(fine[q])]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1, 40, 10**12])
def test_walks_find_what_a_full_scan_finds(scale):
    rng = np.random.default_rng(scale % 97)
    vectors = rng.integers(-6, 7, (700, 5)) * scale
    vectors[100:400] = vectors[100]
    ids = rng.permutation(700)
    trees = [build_tree(ids[s::3], vectors[s::3], 6, leaf_rows=8) for s in range(3)]
    for t in trees:
        assert all(t["span"][n][1] - t["span"][n][0] <= 8 or not (t["high"][n] - t["low"][n]).any() for n in range(len(t["span"])) if t["child"][n][0] < 0)
    got = search_block(trees, ids[:50], vectors[:50], 5)
    want = brute([(int(i), [x / 256 for x in v.tolist()]) for i, v in zip(ids, vectors)], [(int(i), 0) for i in ids[:50]], 5) if scale < 50 else None
    if want is not None:
        assert sorted((q, i, s) for q, i, s in got) == sorted((q, i, s) for q, _, i, s in want)
    else:
        for q, i, s in got:
            a, b = vectors[list(ids).index(q)], vectors[list(ids).index(i)]
            assert s == max(-(2**63) + 1, min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a, b))))


def test_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 30)
    monkeypatch.setattr(kdtree, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 8]) for i in range(200)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(200, 320)]
    rows += [(400, None), (401, []), (402, [1.0, None, 1.0, 1.0]), (403, [math.nan] * 4), (404, [math.inf] * 4), (None, [9.0] * 4)]
    rows += [(450, [1.0, 2.0]), (451, [3.0, 4.0]), (500, [1.0]), (50, [-9.0, 0.0, 0.0, 0.0]), (7, rows[7][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    asked = frame.filter("vec_id % 50 = 0")
    got = sorted(tuple(r) for r in top_k(frame, asked, k=5).collect())
    assert got == brute(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0], 5)
    assert top_k(frame.limit(0), asked).count() == 0 and top_k(frame, asked.limit(0)).count() == 0
    few = frame.filter("vec_id in (450, 451)")
    assert [tuple(r) for r in top_k(few, few.filter("vec_id = 450")).collect()] == [(450, 1, 451, 256 * 256 * 11)]

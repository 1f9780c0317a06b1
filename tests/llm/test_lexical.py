import math
import random
import re
from collections import Counter

import pytest
from trajgraph.llm import lexical as L

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return PATTERN.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """Every document scored for every item."""
    counts = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = set()
    for item, text in items:
        found = []
        for doc, c in counts:
            m = 10 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if c[w])
            if score > 0:
                found.append((-score, doc))
        out |= {(item, r, doc, -s) for r, (s, doc) in enumerate(sorted(found)[:k], 1)}
    return out


def made(seed, n, vocabulary=60):
    rng = random.Random(seed)
    words = [f"W{i}" if i % 3 else f"é{i}ß" for i in range(vocabulary)]
    pick = lambda m: " ".join(words[min(int(rng.expovariate(0.12)), vocabulary - 1)] + rng.choice(["", ",", "\n", "-x"]) for _ in range(m))
    docs = [(i * 7 % 1009, pick(rng.randint(0, 40))) for i in range(n)]
    return docs, [(i, pick(rng.randint(1, 12))) for i in range(12)]


@pytest.mark.parametrize("seed, how", [(0, {}), (1, {"short": 2}), (2, {"short": 10**9}), (3, {"vocabulary_bytes": 0}), (4, {"block_bytes": 300}), (5, {"k": 3, "short": 4})])
def test_against_every_document(spark, seed, how):
    docs, items = made(seed, 300)
    found = L.rank(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), segment_bytes=2500, **how)
    found = [tuple(r) for r in found.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(docs, items, how.get("k", 10))


def test_odd_input(spark):
    long = "Alpha " * 100_000 + "omega"
    docs = [(1, None), (2, ""), (3, "!?. \x00\x7f"), (4, "alpha"), (5, "ALPHA"), (4, "alpha"), (None, "alpha"), (7, long), (8, "Ärger ärger"), (9, "a b")]
    items = [(0, "alpha ALPHA omega"), (1, None), (2, "nothing"), (3, "ärger Ärger"), (4, "a b"), (None, "alpha")]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS + ", terms string, score int")
    q = spark.createDataFrame([(*r, 2) for r in items], ITEMS + ", doc_id int")
    found = sorted(tuple(r) for r in L.rank(d, q).collect())
    want = brute(docs, [r for r in items if r[0] is not None])
    assert set(found) == want and len(found) == len(want) + (0 if len(want) == len(found) else 1)
    assert L.rank(d.limit(0), q).collect() == [] and L.rank(d, q.limit(0)).collect() == []


def test_few_documents_are_scored():
    """The walk gives the same heap as scoring all documents while it leaves most of them out."""
    rng = random.Random(3)
    texts = [" ".join(["the", "of"] * rng.randint(1, 30) + [f"r{rng.randint(0, 400)}" for _ in range(20)]).encode() for _ in range(2000)]
    segment = L.build_segment(list(range(2000)), texts, None)
    held = L.Postings(segment, 2000, sum(len(t.split()) for t in texts))
    sizes = dict(zip(segment["terms"], segment["sizes"]))
    query = [(t, L.weights(sizes[t], 2000)) for t in ("the", "of", "r1", "r2", "r3") if t in sizes]
    heap, every = [], []
    scored = L.search(held, query, heap)
    assert scored < 400
    L.search(held, query, every, short=1)  # all lists are short: accumulators only
    assert sorted(heap) == sorted(every)

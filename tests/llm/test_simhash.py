import random
import re

import xxhash
from pyspark.sql import functions as F
from trajgraph.llm.components import components
from trajgraph.llm.simhash import _tables, ball, fingerprint, keep_first, link, near_groups, op4_simhash


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(prints):
    """Component of each (id, fingerprint) by plain search over all pairs of different fingerprints."""
    nodes = {}
    for doc, fp in prints:
        nodes.setdefault(fp, []).append(doc)
    seen = {}
    for start in nodes:
        if start in seen:
            continue
        stack, group = [start], [start]
        seen[start] = group
        while stack:
            a = stack.pop()
            for b in nodes:
                if b not in seen and bin(a ^ b).count("1") <= 2:
                    seen[b] = group
                    group.append(b)
                    stack.append(b)
    out = []
    for doc, fp in prints:
        ids = [d for f in seen[fp] for d in nodes[f] if d is not None]
        out.append((doc, f"{fp:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, brute_print(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in op4_simhash(spark, sf).collect()), key=repr)
    assert got == brute_groups(docs)
    assert len({r[2] for r in got}) < len(got)


def test_links_reach_what_all_pairs_reach(spark):
    rng = random.Random(5)
    prints = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            prints.add(x)
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
    prints |= {1 << b for b in range(64)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    frame = spark.createDataFrame([(signed(v),) for v in prints], "fp long")
    groups = {}
    for _, fp, smallest in brute_groups([(v, v) for v in prints]):
        groups.setdefault(smallest, set()).add(signed(int(fp, 16)))
    close = {(a, b) for a in map(signed, prints) for b in map(signed, prints) if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    for segments, hot in ((1, 64), (2, 64), (4, 64), (8, 10**9), (2, 3), (4, 1)):
        links = link(frame, segments, hot=hot)
        pairs = {tuple(sorted(r)) for r in links.collect()}
        assert pairs <= close and (hot < 10**9 or pairs == close)
        found = {r.node: r.component for r in components(links).collect()}
        for members in groups.values():
            assert {found.get(m, m) for m in members} == {min(members)}


def test_each_segment_has_a_table(spark):
    """Rows of the tables and sizes of the balls follow the number of segments."""
    frame = spark.createDataFrame([(5,), (-1,), (1 << 40,)], "fp long")
    for segments in (1, 2, 4, 8):
        width = 64 // segments
        rows = {tuple(r) for r in _tables(frame, segments).collect()}
        cut = lambda v, s: (v & (1 << 64) - 1) >> s * width & (1 << width) - 1  # noqa: E731, B023
        low = (1 << width) - 1
        assert {(s, v & low, f) for s, v, f in rows} == {(s, cut(v, s), v) for v in (5, -1, 1 << 40) for s in range(segments)}
        assert len(rows) == 3 * segments
    assert len(ball(64, 2)) == 1 + 64 + 2016 and len(ball(32, 1)) == 33 and ball(16, 0) == [0]
    assert link(frame.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(1000, 1001), (5, 5)], "src long, dst long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}
    assert components(edges.limit(0)).count() == 0


HARD = [None, "", "  \n\x0b", "One", "one", "one two", "One  TWO\tthree", "one two three", "é É ſ K", "a" * 90_000, "w " * 100_000,
        "the same text of a few words here " * 9, "the same text of a few words here " * 9 + "end"]


def test_hard_texts(spark):
    assert [fingerprint((t or "").encode()) for t in HARD] == [brute_print(t) for t in HARD]
    rows = [(i, t, "x") for i, t in enumerate(HARD)] + [(3, "One", "x"), (None, "One", "x"), (None, "alone among many words", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("kept_id", F.lit(1))
    got = near_groups(frame).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_groups([(r[0], brute_print(r[1])) for r in rows])
    kept = keep_first(frame)
    assert kept.columns == frame.columns
    assert near_groups(frame.limit(0)).count() == 0
    groups = {r[0]: r[2] for r in got if r[0] is not None}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == set(groups.values()) - {None}


def test_nothing_of_every_fingerprint_is_broadcast(spark):
    from plan_rows import node_rows

    prints = spark.range(3000).select(F.xxhash64("id").alias("fp")).repartition(4, F.xxhash64("fp"))
    # 66 rows for each fingerprint are sized as one before they are made.
    assert sum(node_rows(link(prints), "BroadcastExchange")) == 0
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("text of"), F.col("id") % 7, F.col("id") % 5).alias("text"))
    assert sum(node_rows(near_groups(docs), "BroadcastExchange")) == 0

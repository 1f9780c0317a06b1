import random

import numpy as np

from trajgraph.llm import similar
from trajgraph.llm.similar import keep_first, shingle_set, similar_groups


def brute_groups(rows):
    """The smallest id of each row's group by comparing all pairs of sets."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared) and group[a] != group[b]:
                old = group[a]
                group = [group[b] if g == old else g for g in group]
    ids = {}
    for (i, _), g in zip(rows, group):
        ids.setdefault(g, []).append(i)
    return sorted((i, min(ids[g])) for (i, _), g in zip(rows, group))


def planted():
    """Texts with copies at similarities around and above 0.8, a chain, a hot group and a line common to all of some texts."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    out = []
    for n, changes in ((100, 1), (100, 2), (100, 3), (300, 3), (300, 5), (300, 6), (300, 9), (1000, 15), (1000, 22), (1000, 30)):
        for _ in range(4):
            base = text(n)
            out.append(" ".join(base))
            for at in rng.sample(range(n), changes):
                base[at] = "new" + rng.choice(words)
            out.append(" ".join(base))
    chain = text(200)
    for i in range(12):
        chain[15 * i] = f"link{i}"
        chain[15 * i + 5] = f"ring{i}"
        out.append(" ".join(chain))
    hot = text(150)
    for i in range(60):
        copy = list(hot)
        for at in rng.sample(range(150), 1 + i % 3):
            copy[at] = f"hot{i}"
        out.append(" ".join(copy))
    line = " ".join(text(12))
    out += [line + " " + " ".join(text(20)) for _ in range(40)]
    out += ["", "  ", "One", "one", "one two", "a b c d e", "A  b c d E", "a b c d f"]
    rows = list(enumerate(out))
    rng.shuffle(rows)
    return rows


def test_every_similar_pair_is_linked(spark):
    rows = planted()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_groups(rows)
    assert sorted((r.doc_id, r.component_id) for r in similar_groups(frame).collect()) == want
    assert sorted(r.doc_id for r in keep_first(frame).collect()) == sorted({c for _, c in want})
    assert similar_groups(frame.limit(0)).count() == 0


def test_nulls_and_repeated_ids(spark):
    rows = [(None, "alone among many words"), (3, "One"), (3, "one"), (3, "quite another text"), (None, None), (7, ""), (9, "quite  another TEXT")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in similar_groups(frame).collect()), key=repr)
    assert got == sorted([(None, None), (3, 3), (3, 3), (3, 3), (None, 7), (7, 7), (9, 3)], key=repr)
    assert len(shingle_set(b"a b c d e f a b c d e")) == 6


def test_similar_sets_share_a_rare_key():
    rng = np.random.default_rng(5)
    counts = np.ones(1 << 6, np.int64) * rng.integers(1, 5, 1 << 6)
    least = similar._classes(400)
    met = 0
    for _ in range(1500):
        n = int(rng.integers(1, 200))
        base = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        other = np.unique(np.concatenate([base[rng.random(len(base)) > rng.random() / 4], rng.integers(-(1 << 62), 1 << 62, int(rng.integers(0, 1 + n // 6)))]))
        small, large = sorted((base, other), key=len)
        shared = len(np.intersect1d(small, large))
        if not len(small) or 5 * shared < 4 * (len(small) + len(large) - shared):
            continue
        (a, home), (b, _) = (similar.rare_keys(s, counts, least) for s in (small, large))
        assert set(a[home].tolist()) & set(b.tolist())
        met += 1
    assert met > 300


def test_texts_that_only_share_passages_are_not_compared_with_one_another(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(150)]
    texts = []
    for i in range(240):  # changed at one place they are similar, at five they are alike and not similar
        copy = list(base)
        for k, at in enumerate(rng.sample(range(5, 145, 6), 1 if i % 4 == 0 else 5)):
            copy[at] = f"own{i}x{k}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    compared, check = [], similar._similar

    def counting(pairs, sets):
        compared.append(pairs.count())
        return check(pairs, sets)

    monkeypatch.setattr(similar, "_similar", counting)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.component_id) for r in similar_groups(frame).collect()) == brute_groups(rows)
    assert sum(compared) < 8 * len(rows), compared


def test_texts_are_not_broadcast(spark):
    from plan_rows import node_rows

    rows = [(i, f"{'one two three four five six ' * 3}{i % 5} {i % 3}") for i in range(40)] + [(99, None)]
    groups = similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(node_rows(groups, "BroadcastExchange")) == 0
    assert sorted(tuple(r) for r in groups.collect()) == brute_groups(rows)

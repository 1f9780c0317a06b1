"""Sequence mining against a plain sequential version on small chains."""

import random

import pytest
from trajgraph.operators import mining as M

SCHEMA = "chain_id string, pos int, src string, elem string, tgt string"


def chains_df(spark, chains):
    return spark.createDataFrame(
        [(c, i, *t) for c, toks in chains.items() for i, t in enumerate(toks)], SCHEMA
    ).repartition(3)


def sequential(chains, num_merges, min_freq, strict):
    """Token lists, with atomic tokens as tuples and merged ones as ids."""
    current = {c: list(t) for c, t in chains.items()}
    parts = {}
    n_atomic = len({t for toks in chains.values() for t in toks})

    def comps(tok):
        if isinstance(tok, tuple):
            return [tok]
        return [] if strict else parts[tok]

    def key(a, b):
        full = comps(a) + comps(b)
        if not full:
            return (a, b)
        return tuple(full[:-1]) + ((full[-1][0], full[-1][1], "*"),)

    history = []
    for i in range(num_merges):
        counts, first = {}, {}
        for c in sorted(current):
            for a, b in zip(current[c], current[c][1:]):
                k = key(a, b)
                counts[k] = counts.get(k, 0) + 1
                first.setdefault(k, (a, b))
        if not counts:
            break
        best = max(counts, key=lambda k: counts[k])  # the first met wins ties
        if counts[best] < min_freq:
            break
        name = f"M{n_atomic + i}"
        a, b = first[best]
        parts[name] = [x for t in (a, b) for x in ([t] if isinstance(t, tuple) else parts[t])]
        history.append((name, counts[best], len(parts[name])))
        for c, toks in current.items():
            out, j = [], 0
            while j < len(toks):
                if j + 1 < len(toks) and key(toks[j], toks[j + 1]) == best:
                    out.append(name)
                    j += 2
                else:
                    out.append(toks[j])
                    j += 1
            current[c] = out
    return history, current


def text(tok):
    return tok if isinstance(tok, str) else "|".join(tok)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("seed, how", [(1, {}), (2, {"compact": 2}), (3, {"max_pairs": 0})])
def test_mining_equals_sequential(spark, seed, how, strict):
    rng = random.Random(seed)
    pages = "ABC"
    chains = {
        f"c{i:02d}": [(rng.choice(pages), rng.choice("xy"), rng.choice(pages)) for _ in range(rng.randint(0, 9))]
        for i in range(25)
    }
    want_history, want_chains = sequential(chains, 8, 2, strict)
    merges, tokens = M.mine_sequences(chains_df(spark, chains), 8, 2, strict, **how)
    got = [(r.merged_id, r.frequency, len(r.components)) for r in merges.orderBy("merge_order").collect()]
    assert got == want_history
    out = {}
    for r in tokens.orderBy("chain_id", "pos").collect():
        out.setdefault(r.chain_id, []).append(r.token)
    assert out == {c: [text(t) for t in toks] for c, toks in want_chains.items() if toks}


def test_three_equal_tokens_merge_from_the_left(spark):
    a = ("p", "e", "p")
    out = M.merge_top_pair(chains_df(spark, {"c": [a, a, a], "d": [a, a, a, a]}), "M")
    got = {}
    for r in out.orderBy("chain_id", "pos").collect():
        got.setdefault(r.chain_id, []).append(r.token)
    assert got == {"c": ["M", "p|e|p"], "d": ["M", "M"]}


def test_pairs_that_differ_in_the_last_target_are_one(spark):
    df = chains_df(spark, {"a": [("1", "x", "2"), ("2", "y", "3")], "b": [("1", "x", "2"), ("2", "y", "4")]})
    (row,) = M.pair_frequencies(df).collect()
    assert (row.frequency, row.second_token) == (2, "2|y|3")


def test_nothing_to_merge(spark):
    merges, tokens = M.mine_sequences(chains_df(spark, {"a": [("1", "x", "2"), ("2", "y", "3")]}), 5, 2)
    assert merges.count() == 0 and tokens.count() == 2
    assert M.rank_composites(merges).count() == 0

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from trajgraph.llm.substring import Chunk, low_rounds, remove_repeats


def brute(rows, window):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, words in texts:
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if i is not None:
                least[w] = min(i, least.get(w, i))
    out = []
    for i, words in texts:
        gone = set()
        for k in range(len(words) - window + 1):
            if i is not None and least[tuple(words[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=repr)


def texts(seed, letters, docs, length):
    rng = random.Random(seed)
    word = lambda: rng.choice(letters)
    pool = [[word() for _ in range(rng.randrange(1, length))] for _ in range(docs // 2)]
    out = []
    for _ in range(docs):
        words = []
        for _ in range(rng.randrange(1, 4)):
            part = rng.choice(pool)
            cut = rng.randrange(len(part))
            words += rng.choice([part, part[cut:], part[:cut], [word()] * rng.randrange(1, 40), [word() for _ in range(9)]])
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("window,letters", [(13, "ab"), (13, "abcdefghijklmnop"), (5, "abc"), (2, "abcd"), (30, "abcdefgh")])
def test_against_all_windows(spark, window, letters):
    rows = list(enumerate(texts(window, letters, 60, 50)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in remove_repeats(frame, window=window).collect()), key=repr)
    assert got == brute(rows, window)


def test_every_window_without_runs_has_a_determined_symbol_and_equal_windows_equal_keys():
    rng = np.random.default_rng(4)
    words = [[b"%d" % x for x in np.cumsum(rng.integers(1, 50, 400)) % 97] for _ in range(6)]
    words += [[b"x", *words[0][50:120], b"y"], words[1][3:60], words[2][:13]]
    chunk = Chunk([b" ".join(w) for w in words])
    at, key = chunk.keys(13)
    flat = [w for mine in words for w in mine]
    by_window = {}
    for i, k in zip(at.tolist(), key.tolist()):
        assert by_window.setdefault(tuple(flat[i : i + 13]), k) == k
    assert not (key == chunk.digest(at, 13)).any()
    assert low_rounds(13) == 2 and low_rounds(12) == 1 and low_rounds(4) == 0


def test_digests_follow_the_words_only():
    words = [[b"a", b"b", b"c", b"a", b"b"], [b"b", b"c"], [b"c", b"b"]]
    chunk = Chunk([b" ".join(w) for w in words])
    one, two = (chunk.digest(np.array([0, 3, 1, 5, 7]), np.array([2, 2, 2, 2, 2]), stream) for stream in (0, 1))
    assert one[0] == one[1] and two[0] == two[1] and one[2] == one[3] and two[2] == two[3]
    assert len(set(one.tolist())) == 3


def test_hard_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, long), (5, long), (3, "x " + long + " y"), (None, long), (9, None), (10, ""), (11, "a " * 30), (2, "a\ta\n" * 10), (12, long.replace("w20", "other"))]
    rows += [(20, "b " * 50_000), (21, "b " * 13), (22, "é " + "b " * 12), (30, " ".join(f"w{i}" for i in range(20, 33))), (31, " ".join(f"w{i}" for i in range(20, 32)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("row", F.lit(2))
    got = sorted((tuple(r) for r in remove_repeats(frame).collect()), key=repr)
    assert got == brute(rows, 13)
    assert remove_repeats(frame.limit(0)).count() == 0


def test_query_digest_is_that_of_the_kept_words(spark, sf):
    from trajgraph.llm.substring import op6_substring

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in remove_repeats(docs).collect()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op6_substring(spark, sf).collect()} == kept

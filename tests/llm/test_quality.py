import math
import zlib
from collections import Counter

import numpy as np
import pytest
from trajgraph.llm import quality as Q
from trajgraph.llm.queries import QUERIES

DOCS = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def plain_statistics(text):
    """The statistics by loops over characters and words."""
    logit = lambda a, b: math.log((a + 0.5) / (max(b - a, 0) + 0.5))
    raw = text.encode()
    words, lines = raw.split(), raw.split(b"\n")
    lengths = [len(w) for w in words]
    upper = sum("A" <= c <= "Z" for c in text)
    letters = upper + sum("a" <= c <= "z" for c in text) + sum(ord(c) > 127 for c in text)
    common = sum(c in ".,;:'\"!?-()" for c in text)
    symbols = sum(33 <= ord(c) < 127 and not c.isalnum() and c not in ".,;:'\"!?-()" for c in text)
    same = [a == b for a, b in zip(words, words[1:])]
    run = best = 0
    for s in same:
        run = run + 1 if s else 0
        best = max(best, run)
    word_like = lambda b: bytes([b]).isalnum() or b > 127
    lonely = sum(not any(word_like(b) for b in w) for w in words)
    mixed, i = 0, 0
    while i + 1 < len(raw):
        a, b = raw[i], raw[i + 1]
        if (chr(a).isascii() and chr(a).isalpha() or a > 127) and 32 < b < 127 and not word_like(b) and chr(b) not in ".,;:'\"!?-()":
            mixed, i = mixed + 1, i + 1
        i += 1
    counts = Counter(raw)
    entropy = -sum(c / len(raw) * math.log(c / len(raw)) for c in counts.values())
    mean = sum(lengths) / len(lengths) if lengths else 0.0
    spread = math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths)) if lengths else 0.0
    return [
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(mean), math.log1p(spread), math.log1p(max(lengths, default=0)),
        logit(letters, len(text)), logit(upper, upper + sum("a" <= c <= "z" for c in text)), logit(sum("0" <= c <= "9" for c in text), len(text)),
        logit(common, len(text)), logit(symbols, len(text)), logit(len(set(words)), len(words)),
        logit(max(Counter(words).values(), default=0), len(words)), logit(sum(same), len(words)), math.log1p(best), logit(lonely, len(words)),
        logit(mixed, len(words)), math.log1p(symbols), logit(len(set(lines)), len(lines)), math.log1p(len(text) / len(lines)), entropy,
        math.log(((len(zlib.compress(raw, 1)) if raw else 0) + 1.0) / (len(raw) + 16.0)),
    ]


@pytest.mark.parametrize("text", ["", " \n ", "a", "Über den Wolken.\nÜber den Wolken.", "x x x y y | | *** a*** B!! 12 12 12", "é" * 500, "a\x00b c\td\n\n#x#"])
def test_statistics(text):
    assert np.allclose(Q.statistics(text.encode()), plain_statistics(text))


def test_discriminant_by_definition(spark):
    """The shrunk covariances and log-densities against plain matrix formulas."""
    rng = np.random.default_rng(1)
    z = [np.rint(Q.UNIT * rng.normal(y, 0.5 + y, (60 + 20 * y, Q.WIDTH))).astype(int) for y in (0, 1)]
    sums = {y: (len(z[y]), z[y].sum(axis=0), z[y].T @ z[y]) for y in (0, 1)}
    rule = Q.discriminant(sums, 0.3, 0.1)
    own = [np.cov(x.T / Q.UNIT, bias=True) for x in z]
    common = sum(len(x) * c for x, c in zip(z, own)) / sum(map(len, z))
    asked = np.rint(Q.UNIT * rng.normal(0.5, 1, (5, Q.WIDTH))).astype(int)
    want = 0.0
    for x, c, sign in zip(z, own, (-1, 1)):
        s = 0.7 * c + 0.3 * common
        s = 0.9 * s + 0.1 * np.trace(s) / Q.WIDTH * np.eye(Q.WIDTH)
        d = asked / Q.UNIT - x.mean(axis=0) / Q.UNIT
        want = want + sign * (-0.5 * (d @ np.linalg.inv(s) * d).sum(axis=1) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(Q.difference(rule, asked), want)


def test_sums_over_all_rows(spark):
    """What the driver gets are sums over every labelled row, alike however rows are dealt."""
    docs = spark.createDataFrame([(i, ("word " * (i % 9 + 1) + "*** " * (i % 3)) * (i % 5 + 1)) for i in range(300)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(300)], LABELS)
    one, two = (Q.learn(Q.features(d), labels) for d in (docs.repartition(1), docs.repartition(7)))
    assert (one.centre == two.centre).all() and (one.spread == two.spread).all()
    assert (one.slope, one.offset) == (two.slope, two.offset)
    assert all((a == b).all() for x, y in zip(one.rule, two.rule) for a, b in zip(x[:2], y[:2]))
    stats = np.rint(Q.UNIT * np.array([Q.statistics(r.text.encode()) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]))
    assert np.allclose(one.centre, stats.mean(axis=0)) and np.allclose(one.spread, np.maximum(stats.std(axis=0), 1.0))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in QUERIES["op12_quality"](spark, sf).collect()}
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    right = total = 0
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        assert found[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if found[r.doc_id].held_out:
            right += found[r.doc_id].predicted == r.quality
            total += 1
    assert total > 50 and right / total >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame([(i, "a b c. " * (i % 7 + 1) if i % 2 else "x *** " * (i % 5 + 1)) for i in range(200)], DOCS)
    marks = [(i, i % 2, 0) for i in range(200)]
    other = [(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q, 0) for i, q, _ in marks]
    a, b = (Q.quality(docs, spark.createDataFrame(m, LABELS)).orderBy("doc_id").collect() for m in (marks, other))
    assert a == b


def test_odd_input(spark):
    docs = spark.createDataFrame([(1, None, "p"), (2, "", "q"), (3, "x", "r"), (3, "x", "r"), (None, "y z", None), (6, "é " * 200_000, "s")], DOCS + ", score string")
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (3, 1, 1), (3, 1, 1)], LABELS)
    for labels in (none, odd, odd.withColumn("label", odd.toxic)):
        found = Q.quality(docs, labels).collect()
        assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
        assert [r.held_out for r in found if r.doc_id is None] == [False]
        assert len({r.score for r in found if r.doc_id in (1, 2)}) == 1
    assert Q.quality(docs.limit(0), odd).collect() == []

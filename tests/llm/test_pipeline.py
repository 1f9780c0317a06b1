"""The pipeline's stages against plain versions, on the given documents."""

import re
from collections import defaultdict

import corpus_pipeline as cp
import pytest
from test_packing import check
from test_secrets import PATTERNS, base
from test_similar import brute_groups

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's output in turn, as rows by id."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(cp.stored(stage(spark, out[-1], SF), name))
        if name != "packing":
            assert out[-1].columns == docs.columns
    return [d.collect() for d in out]


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_language_stage_keeps_clean_documents(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert set(after) <= set(before) and all(before[i] == t for i, t in after.items())
    assert all(any(c.isalpha() for c in t) for t in after.values())
    assert len(after) > 0.995 * sum(any(c.isalpha() for c in t or "") for t in before.values())


def test_exact_stage(stages):
    best = {}
    for i, t in texts(stages[1]).items():
        best[t or ""] = max(i, best.get(t or "", i))
    assert set(texts(stages[2])) == set(best.values()) and len(stages[2]) == len(best)


def test_near_stage(stages):
    docs = texts(stages[2])
    kept = {c for _, c in brute_groups(sorted(docs.items()))}
    assert set(texts(stages[3])) == kept and len(stages[3]) == len(kept) < len(docs)


def test_secret_stage(stages):
    before, after = {r.doc_id: r for r in stages[3]}, {r.doc_id: r for r in stages[4]}
    owners = defaultdict(set)
    for r in before.values():
        for s in base(r.text):
            owners[s[5]].add(r.source)
    assert set(before) == set(after)
    masked = 0
    for i, r in before.items():
        cut, at = "", 0
        for s in sorted(base(r.text), key=lambda s: s[3]):
            live = len(owners[s[5]]) <= 3 and len(set(s[5])) >= 6 and re.search("[0-9]", s[5]) and re.search("[A-Za-z]", s[5])
            if live and s[3] >= at:
                cut, at = cut + r.text[at : s[3]] + "[SECRET]", s[4]
                masked += 1
        want = cut + r.text[at:]
        assert after[i].text == want and after[i].n_chars == len(want) and after[i].source == r.source
    assert masked and len(PATTERNS) == 3


def test_packing_stage(stages):
    check(stages[5], texts(stages[4]))


def test_empty_and_null_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    odd = docs.limit(40).unionByName(spark.createDataFrame([(None, None, None, None, None), (5000, "", "en", "s", 0), (None, "the text", None, None, None)], docs.schema))
    for _, stage in cp.STAGES:
        odd = cp.stored(stage(spark, odd, SF), "odd")
    assert odd.count() > 0

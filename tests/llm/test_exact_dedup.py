import hashlib

import pytest
from pyspark.sql import functions as F
from trajgraph.llm import exact_dedup as x

ROWS = [
    (1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "A"), (7, "a "), (8, "x" * 100_000), (9, "x" * 100_000), (10, "x" * 99_999 + "y"),
    (11, "é"), (12, "é"), (3, "a"), (13, "solo"), (None, "nil"), (None, "b"), (None, "nil"),
]


def frame(spark):
    rows = [(i, t, 0, "k") for i, t in ROWS] + [(100 + i, f"t{i % 37}", 0, "k") for i in range(400)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, key int, SHA string")


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = groups[t or ""]
        keep = max((d for d in ids if d is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"bucket_keys": 3, "max_depth": 5}, {"bucket_keys": 1, "max_depth": 20}, {"key_bits": 2, "bucket_keys": 2}, {"key_bits": 1}])
def test_groups_of_equal_texts(spark, options):
    rows, df = frame(spark)
    got = sorted((tuple(r) for r in x.exact_dedup(df, **options).collect()), key=repr)
    assert got == brute(rows)
    assert x.exact_dedup(df.limit(0), **options).count() == 0


def test_buckets_split_and_chains_grow(spark):
    _, df = frame(spark)
    index = x.build_index(df, bucket_keys=4, max_depth=8).collect()
    sizes = {}
    for r in index:
        assert r.bucket == (r.key & (1 << 64) - 1) >> (64 - r.bucket_depth) if r.bucket_depth else r.bucket == 0
        sizes[r.bucket_depth, r.bucket] = sizes.get((r.bucket_depth, r.bucket), 0) + 1
    assert max(sizes.values()) <= 4 and len({d for d, _ in sizes}) > 1
    chained = x.build_index(df, key_bits=1).collect()
    assert {r.key for r in chained} <= {0, -(1 << 63)}
    assert len(chained) == len({t or "" for _, t, *_ in frame(spark)[0]}) and max(r.link for r in chained) > 5


def test_kept_rows_keep_their_columns(spark):
    rows, df = frame(spark)
    df = df.withColumn("kept_id", F.lit(1))
    out = x.keep_one(df)
    assert out.columns == df.columns
    want = {(keep, sha) for _, keep, _, _, sha in brute(rows)}
    got = [(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_owners_hold_ranges_of_the_directory(spark):
    """With the parameters of the registered query there are many buckets, and each index file holds a range of them."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    index, directory, bits = x._indexed(docs, "doc_id", "text")
    assert directory.select("first").distinct().count() > 1
    files = index.groupBy(F.input_file_name().alias("file")).agg(F.min("first").alias("low"), F.max("first").alias("high")).collect()
    ends = sorted((r.low, r.high) for r in files)
    assert len(ends) > 1 and all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    known = x.routed(docs.select(F.xxhash64("text").alias("key")).filter("text is not null"), directory, bits)
    assert known.filter(F.shiftrightunsigned("key", 64 - bits) < F.col("first")).isEmpty()

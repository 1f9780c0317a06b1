"""Exact top-k by inner product with a KD-tree per shard.

Vectors are dealt to shards by a hash of their id. A task builds the tree of a shard: median splits of the widest dimension down to
leaves, each node with the tight box of its vectors. Trees lie in parts of a few shards; every tree is written and shuffled once, and the
queries are sent to each part. Within a part a query walks each tree best first: the bound of a node is the largest inner product its
box allows, a heap gives the best node next, and the walk ends when no bound reaches the query's k-th score. That score is carried
from shard to shard. The few rows left per query and part are ranked by Spark.

Memory: a task holds one shard (``SHARD_ROWS`` vectors), or one part of ``PART_SHARDS`` shards with one Arrow batch of queries. All numbers are
whole, and sums that stay below 2**53 are exact in floating point; larger ones are taken with Python's integers.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_value, only, stored, table
from .meet import meet, packed, parts_of, rows_of

by_value(__name__)

#: Vectors of a shard, queries walked at once, vectors of a leaf.
SHARD_ROWS = 4096
BLOCK_ROWS = 256
LEAF_ROWS = 128


def _dump(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(data: bytes) -> dict:
    with np.load(io.BytesIO(data)) as held:
        return {name: held[name] for name in held.files}


def _matrix(batch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of an Arrow table, one row per id (the smallest vector where an id repeats)."""
    ids = batch.column("id").to_numpy()
    flat = batch.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    vectors = flat.reshape(len(ids), -1)
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return ids[first], vectors[first]


def build_tree(ids: np.ndarray, vectors: np.ndarray, keep: int, leaf_rows: int = LEAF_ROWS) -> dict:
    """Arrays of a tree. Of equal vectors only the ``keep`` smallest ids can be among the results, so only those stay."""
    order = np.lexsort((ids, *vectors.T))
    ids, vectors = ids[order], vectors[order]
    new = np.ones(len(ids), bool)
    new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
    start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    few = np.arange(len(ids)) - start < keep
    ids, vectors = ids[few], vectors[few]
    low, high, child, span = [], [], [], []
    rows = np.arange(len(ids))

    def add(a, b):
        low.append(vectors[rows[a:b]].min(axis=0))
        high.append(vectors[rows[a:b]].max(axis=0))
        child.append((-1, -1))
        span.append((a, b))
        return len(low) - 1

    todo = [add(0, len(ids))]
    while todo:
        node = todo.pop()
        a, b = span[node]
        width = high[node] - low[node]
        if b - a <= leaf_rows or not width.max():
            continue
        axis, mid = int(width.argmax()), (a + b) // 2
        part = rows[a:b]
        rows[a:b] = part[np.argpartition(vectors[part, axis], mid - a)]
        left, right = add(a, mid), add(mid, b)
        child[node] = (left, right)
        todo += [left, right]
    return {
        "ids": ids[rows],
        "vectors": vectors[rows],
        "low": np.array(low),
        "high": np.array(high),
        "child": np.array(child),
        "span": np.array(span),
    }


def walk(tree: dict, own: int, query: np.ndarray, bounds: np.ndarray, best: list, k: int) -> None:
    """Best-first walk of one query; ``best`` is its heap of ``(score, -id)`` and comes filled from earlier shards."""
    child, span = tree["child"], tree["span"]
    agenda = [(-bounds[0], 0)]
    while agenda:
        bound, node = heapq.heappop(agenda)
        if len(best) == k and -bound < best[0][0]:
            return
        left, right = child[node]
        if left >= 0:
            for c in (left, right):
                if len(best) < k or bounds[c] >= best[0][0]:
                    heapq.heappush(agenda, (-bounds[c], c))
            continue
        a, b = span[node]
        scores = tree["vectors"][a:b] @ query
        hits = np.flatnonzero(scores >= best[0][0]) if len(best) == k else range(b - a)
        for i in hits:
            other = int(tree["ids"][a + i])
            if other == own:
                continue
            item = (int(scores[i]), -other)
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)


def search_block(trees: list[dict], ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """``(query, vector, score)`` of the best ``k`` of every query over the trees, one tree after the other."""
    best: list[list] = [[] for _ in ids]
    largest = lambda x: max(abs(int(x.min())), abs(int(x.max())))
    for tree in trees:
        exact = queries.shape[1] * max(1, largest(tree["vectors"])) * max(1, largest(queries)) < 1 << 53
        kind = np.float64 if exact else object
        one = tree | {name: tree[name].astype(kind) for name in ("vectors", "low", "high")}
        asked = queries.astype(kind)
        zero = asked * 0
        bounds = np.maximum(asked, zero) @ one["high"].T + np.minimum(asked, zero) @ one["low"].T
        for i, own in enumerate(ids.tolist()):
            walk(one, own, asked[i], bounds[i], best[i], k)
    top = (1 << 63) - 1
    return [(q, -other, max(-top, min(top, score))) for q, found in zip(ids.tolist(), best) for score, other in found]


def usable(vector: str) -> Column:
    """Whether a vector is not null, not empty and holds finite numbers only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors with the largest inner product for every query, ties to the smaller id.

    A component ``x`` counts as ``floor(scale * x)``. A query never finds its own id. Vectors that are null, empty or hold null or
    non-finite components take no part, nor do rows without id; vectors of another length than the query's are no candidates. Of rows
    that repeat an id the smallest vector counts. Scores beyond 64 bits are cut to the range of a long.
    """
    whole = F.transform(F.col("v"), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))

    def rows(df):
        kept = only(df, id=F.col(id_col).cast("long"), v=vector_col).filter(F.col("id").isNotNull() & usable("v"))
        return kept.select("id", whole.alias("vector"), F.size("v").alias("width"))

    def plant(key, part):
        import pyarrow as pa

        ids, vecs = _matrix(part)
        data = _dump(**build_tree(ids, vecs, k + 1))
        return pa.table({"width": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

    loaded: list = [None, []]

    def search(entries, data):
        import pyarrow as pa

        if loaded[0] is not entries or len(loaded[1]) != len(entries):
            loaded[:] = entries, [_load(e) for e in entries]
        asked = [np.frombuffer(d, "<i8") for d in data]
        found = []
        for at in range(0, len(asked), BLOCK_ROWS):
            some = np.stack(asked[at : at + BLOCK_ROWS])
            found += search_block(loaded[1], some[:, 0], some[:, 1:], k)
        columns = zip(*found) if found else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    held = rows(vectors)
    shards, place = rows_of(held, SHARD_ROWS)
    planted = held.withColumn("shard", place).groupBy("width", "shard").applyInArrow(plant, "width int, shard int, data binary")
    trees = stored(planted, "kd-trees")
    one = rows(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    asked = stored(one.select(F.size("vector").alias("width"), packed(F.array("id"), F.col("vector")).alias("data")), "kd-queries")
    parts = parts_of(shards, int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = meet(trees, asked, parts, search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum([z[1] * z[2] FOR z IN list_zip(q.e, c.e)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

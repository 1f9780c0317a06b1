"""Hard-negative mining with rotated one-bit codes.

Index: vectors are dealt to shards by a hash of their id. Within a shard they are grouped around a few centres; the residual of a vector
to its centre is turned by one fixed random rotation and kept as one sign bit for each dimension, together with its alignment, the inner
product of the residual with its own code vector. What the aligned code vector leaves over is coded in the same way, ``LAYERS`` times; the
length of the last rest is kept.

Search: the query is rotated too and cut into bit planes, so that its inner product with a code vector is a sum of popcounts. The aligned
code vectors of all layers estimate the score. The last rest stands at a right angle to the last code vector, so by Cauchy-Schwarz it adds at
most its length times the part of the query at a right angle to that code vector. This gives an interval that holds the score for certain;
the share of the query lost in the bit planes widens it. Only rows whose interval can still matter are scored in whole numbers.

For an anchor the best rows of its label are its positives. For each positive, the best rows of other labels are kept whose score lies
between a share of the positive's score and the positive's score.

Memory: a task holds one part of the index (``PART_SHARDS`` shards of ``SHARD_ROWS`` vectors) and one Arrow batch of anchors. All scores are
whole; sums that stay below 2**53 are exact in floating point, larger ones are taken with Python's integers.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_value, only, stored, table
from .meet import meet, packed, parts_of, rows_of

by_value(__name__)

#: Vectors of a shard and centres within it.
SHARD_ROWS = 4096
CENTRES = 16
#: One-bit codes of a vector, and bit planes of a query.
LAYERS = 4
PLANES = 6
SEED = 42
POSITIVES = 5
NEGATIVES = 5
#: A negative scores at least this share of its positive, in hundredths, and at most as much as the positive.
LEAST_PERCENT = 80


def dump(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load(data: bytes) -> dict:
    with np.load(io.BytesIO(data), allow_pickle=False) as held:
        return {name: held[name] for name in held.files}


def rotation(width: int) -> np.ndarray:
    """The fixed random rotation for vectors of ``width`` components."""
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, width)))[0]


def centres_of(vectors: np.ndarray, count: int = CENTRES, rounds: int = 4) -> np.ndarray:
    """A few centres of ``vectors`` by rounds of averaging, started from rows far apart in order."""
    centres = vectors[np.linspace(0, len(vectors) - 1, min(count, len(vectors))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(vectors, centres)
        for i in range(len(centres)):
            mine = vectors[near == i]
            if len(mine):
                centres[i] = mine.mean(axis=0)
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * vectors @ centres.T).argmin(axis=1)


def encode(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> dict:
    """The codes of one shard: rows ordered by label, then by centre.

    For each layer ``bits`` are the packed signs and ``align`` is the factor of the code vector of plus and minus ones; ``coded`` and
    ``rest`` are the lengths of what all layers stand for and of what they leave.
    """
    wide = vectors.astype(np.float64)
    centres = centres_of(wide)
    near = nearest(wide, centres)
    order = np.lexsort((ids, near, labels))
    ids, labels, vectors, wide, near = ids[order], labels[order], vectors[order], wide[order], near[order]
    turned = (wide - centres[near]) @ rotation(vectors.shape[1])
    rest, bits, ones, align = turned, [], [], []
    for _ in range(LAYERS):
        signs = rest >= 0
        along = np.abs(rest).mean(axis=1)
        rest = rest - along[:, None] * np.where(signs, 1.0, -1.0)
        bits.append(words_of(np.packbits(signs, axis=1)))
        ones.append(signs.sum(axis=1))
        align.append(along)
    return {
        "ids": ids,
        "labels": labels,
        "vectors": vectors,
        "near": near.astype(np.int32),
        "centres": centres,
        "bits": np.array(bits),
        "ones": np.array(ones),
        "align": np.array(align),
        "coded": norms(turned - rest),
        "rest": norms(rest),
    }


def norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


def words_of(packed: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words."""
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


class Query:
    """A query prepared for one width: rotated and cut into bit planes."""

    def __init__(self, vector: np.ndarray, turn: np.ndarray):
        self.vector = vector
        wide = vector.astype(np.float64)
        self.square = float(wide @ wide)
        turned = wide @ turn
        self.low = float(turned.min())
        self.step = max((float(turned.max()) - self.low) / ((1 << PLANES) - 1), 1e-300)
        cells = np.clip(np.rint((turned - self.low) / self.step), 0, (1 << PLANES) - 1).astype(np.int64)
        lost = turned - (self.low + self.step * cells)
        self.lost = float(np.sqrt(lost @ lost))
        self.total = int(cells.sum())
        self.width = len(turned)
        self.planes = words_of(np.packbits((cells[None, :] >> np.arange(PLANES)[:, None]) & 1, axis=1).astype(np.uint8))

    def bounds(self, shard: dict, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score of the rows, by popcounts and Cauchy-Schwarz."""
        middle = (shard["centres"] @ self.vector.astype(np.float64))[shard["near"][rows]]
        for bits, ones, align in zip(shard["bits"], shard["ones"], shard["align"]):
            hits = np.bitwise_count(bits[rows][:, None, :] & self.planes).sum(axis=2, dtype=np.int64) @ (1 << np.arange(PLANES))
            # Sum over the signs of the quantised query: twice what meets a set bit, less the total.
            signed = self.low * (2 * ones[rows] - self.width) + self.step * (2 * hits - self.total)
            middle = middle + align[rows] * signed
        inner = np.maximum(np.abs(signed) / np.sqrt(self.width) - self.lost, 0.0)
        reach = shard["rest"][rows] * np.sqrt(np.maximum(self.square - inner * inner, 0.0)) + shard["coded"][rows] * self.lost
        reach += 1e-9 * (1.0 + np.abs(middle) + np.sqrt(self.square) * shard["reach"])
        return middle - reach, middle + reach


def prepare(data: bytes) -> dict:
    """A shard as the search uses it, with the rows of each label and the length of its longest vector."""
    shard = load(data)
    wide = shard["vectors"].astype(np.float64)
    shard["reach"] = float(norms(wide).max())
    shard["largest"] = largest(shard["vectors"])
    labels, starts = np.unique(shard["labels"], return_index=True)
    stops = [*starts[1:].tolist(), len(wide)]
    shard["slices"] = {label: slice(a, b) for label, a, b in zip(labels.tolist(), starts.tolist(), stops)}
    shard["floats"] = wide
    return shard


def largest(values: np.ndarray) -> int:
    return max(abs(int(values.min())), abs(int(values.max())))


def scores(shard: dict, rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Whole inner products of some rows of a shard."""
    if len(vector) * max(1, shard["largest"]) * max(1, largest(vector)) < 1 << 53:
        return (shard["floats"][rows] @ vector.astype(np.float64)).astype(np.int64)
    top = (1 << 63) - 1
    whole = shard["vectors"][rows].astype(object) @ vector.astype(object)
    return np.array([max(-top, min(top, int(s))) for s in whole], np.int64)


def best_rows(ids: np.ndarray, found: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The first ``k`` ``(id, score)`` by falling score, then id."""
    order = np.lexsort((ids, -found))[:k]
    return list(zip(ids[order].tolist(), found[order].tolist()))


def kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def find_positives(shards: list[dict], own: int, label: int, query: Query, k: int) -> list[tuple[int, int]]:
    """The best ``k`` other rows of the label over all shards; the k-th score is carried from shard to shard."""
    best: list[tuple[int, int]] = []
    for shard in shards:
        rows = shard["slices"].get(label)
        if rows is None:
            continue
        low, high = query.bounds(shard, rows)
        other = shard["ids"][rows] != own
        least = max(kth(low[other], k), best[-1][1] if len(best) == k else -np.inf)
        alive = np.flatnonzero((high >= least) & other) + rows.start
        found = scores(shard, alive, query.vector)
        ids = np.concatenate([np.array([i for i, _ in best], np.int64), shard["ids"][alive]])
        best = best_rows(ids, np.concatenate([np.array([s for _, s in best], np.int64), found]), k)
    return best


def find_negatives(shards: list[dict], label: int, query: Query, tops: list[int], k: int, percent: int = LEAST_PERCENT) -> list[list[tuple[int, int]]]:
    """For each positive's score in ``tops``, the best ``k`` rows of other labels within its range."""
    best: list[list[tuple[int, int]]] = [[] for _ in tops]
    if not tops or max(tops) < 0:
        return best
    floor = min(-(-percent * t // 100) for t in tops if t >= 0)
    for shard in shards:
        mine = shard["slices"].get(label)
        every = slice(0, len(shard["ids"]))
        low, high = query.bounds(shard, every)
        fit = (high >= floor) & (low <= max(tops))
        if mine is not None:
            fit[mine] = False
        if not fit.any():
            continue
        known, value = np.zeros(len(fit), bool), np.zeros(len(fit), np.int64)
        for n, top in enumerate(tops):
            least = -(-percent * top // 100)
            if top < 0:
                continue
            surely = fit & (low >= least) & (high <= top)
            bar = max(kth(low[surely], k), best[n][-1][1] if len(best[n]) == k else -np.inf, least)
            alive = np.flatnonzero(fit & (high >= bar) & (low <= top))
            new = alive[~known[alive]]
            if len(new):
                value[new], known[new] = scores(shard, new, query.vector), True
            found = value[alive]
            ok = (found >= least) & (found <= top)
            if ok.any():
                ids = np.concatenate([np.array([i for i, _ in best[n]], np.int64), shard["ids"][alive[ok]]])
                best[n] = best_rows(ids, np.concatenate([np.array([s for _, s in best[n]], np.int64), found[ok]]), k)
    return best


def usable(vector: str) -> Column:
    """Whether a vector is not null, not empty and holds finite numbers only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def build_codes(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The stored index ``(width, shard, data)`` of ``rows(id, label, vector, width)``, and its number of shards.

    Of rows that repeat an id the smallest vector counts, then the smallest label.
    """
    shards, place = rows_of(rows, shard_rows)

    def plant(key, part):
        import pyarrow as pa

        ids, labels, vectors = matrix(part)
        data = dump(**encode(ids, labels, vectors))
        return pa.table({"width": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

    made = rows.withColumn("shard", place).groupBy("width", "shard").applyInArrow(plant, "width int, shard int, data binary")
    return stored(made, "one-bit-codes"), shards


def matrix(part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors of an Arrow table, one row per id."""
    ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
    vectors = part.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    order = np.lexsort((labels, *vectors.T[::-1], ids))
    ids, labels, vectors = ids[order], labels[order], vectors[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return ids[first], labels[first], vectors[first]


def mine(
    vectors: DataFrame,
    anchors: Column | str,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percent: int = LEAST_PERCENT,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for every row that meets the condition ``anchors``.

    ``anchors`` is a condition on ``id``. A component ``x`` counts as ``floor(scale * x)``. Rows with a null id, label or vector, an empty
    vector, or a null or non-finite component take no part; vectors of different length never meet. Ties go to the smaller id. An anchor
    without positives, or a positive without negatives in its range, has no rows; nor has a positive of a negative score, whose range is empty. Scores beyond 64 bits are
    cut to the range of a long.
    """
    whole = F.transform(F.col("v"), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    kept = only(vectors, id=F.col(id_col).cast("long"), v=vector_col, label=F.col(label_col).cast("long"))
    kept = kept.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v"))
    rows = kept.select("id", "label", whole.alias("vector"), F.size("v").alias("width"))
    index, shards = build_codes(rows, shard_rows)
    parts = parts_of(shards, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = rows.filter(anchors).groupBy("id").agg(F.min(F.struct("vector", "label")).alias("row"))
    asked = stored(asked.select("id", "row.label", "row.vector", F.size("row.vector").alias("width")), "anchors")

    def unpack(data: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(d, "<i8") for d in data]

    prepared: list = [None, None]

    def ready(entries):
        if prepared[0] is not entries or len(prepared[1]) != len(entries):
            prepared[:] = entries, [prepare(e) for e in entries]
        return prepared[1]

    def answer_positives(entries, data):
        import pyarrow as pa

        shards, out = ready(entries), []
        for q in unpack(data):
            own, label, vector = int(q[0]), int(q[1]), q[2:]
            query = Query(vector, turn(len(vector)))
            out += [(own, *row) for row in find_positives(shards, own, label, query, positives)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([],) * 3)], names=["anchor_id", "positive_id", "score"])

    def answer_negatives(entries, data):
        import pyarrow as pa

        shards, out = ready(entries), []
        for q in unpack(data):
            own, label, n = int(q[0]), int(q[1]), int(q[2])
            chosen, tops, vector = q[3 : 3 + n].tolist(), q[3 + n : 3 + 2 * n].tolist(), q[3 + 2 * n :]
            query = Query(vector, turn(len(vector)))
            for one, top, found in zip(chosen, tops, find_negatives(shards, label, query, tops, negatives, percent)):
                out += [(own, one, other, top, score) for other, score in found]
        names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([],) * 5)], names=names)

    turns: dict[int, np.ndarray] = {}

    def turn(width: int) -> np.ndarray:
        if width not in turns:
            turns[width] = rotation(width)
        return turns[width]

    first = asked.select("width", packed(F.array("id", "label"), F.col("vector")).alias("data"))
    found = meet(index, first, parts, answer_positives, "anchor_id long, positive_id long, score long")
    order = W.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    chosen = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= positives)
    listed = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("n", "positive_id", "score"))).alias("p"))
    second = asked.join(listed, asked["id"] == listed["anchor_id"]).select(
        "width",
        packed(F.array("id", "label", F.size("p").cast("long")), F.concat(F.col("p.positive_id"), F.col("p.score"), F.col("vector"))).alias("data"),
    )
    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    hard = meet(index, stored(second, "anchors-with-positives"), parts, answer_negatives, schema)
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = hard.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label of every seventh row is moved on first, so that some near copies carry different labels."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id AS id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
    [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
  SELECT a.id AS anchor_id, c.id AS other, c.label = a.label AS same,
    list_sum([z[1] * z[2] FOR z IN list_zip(a.e, c.e)])::BIGINT AS score
  FROM v a JOIN v c ON a.id <> c.id AND len(a.e) = len(c.e) WHERE a.id % 100 = 0
),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
),
n AS (
  SELECT p.anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

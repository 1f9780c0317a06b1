"""Ranked lexical search that mixes term-at-a-time and document-at-a-time evaluation.

Index: the documents of a task become segments of bounded text. A segment keeps its documents in ascending id and, for each term, the
documents that hold it with the occurrences. Document counts and lengths are summed over all segments by Spark.

Search: a task holds one segment and a block of queries. The short lists of a query are added up term at a time into accumulators, which then
act as one more iterator, in document order and with an upper bound. Beside it the long lists are walked document at a time: iterators whose
bounds together cannot reach the k-th score are not essential, they are only probed for documents that an essential iterator brings up,
by a jump to that document, and only while the bounds left over can still lift it. The k-th score of a query is carried from segment
to segment of a task; before the walk it is at least the k-th accumulator.

Terms that no query holds are left out of the index as long as the query's vocabulary is small enough to be sent along (``VOCABULARY_BYTES``);
beyond that the index holds all terms. Queries come in blocks of ``BLOCK_BYTES``; each block is one pass over the index. Results depend on
neither. All scores are whole numbers.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_value, only, stored, table
from .words import chunks

by_value(__name__)

#: Text of a segment; a single longer text is a segment of its own.
SEGMENT_BYTES = 4_000_000
#: Most bytes of query terms that are sent to every task, and of the queries of one block.
VOCABULARY_BYTES = 32_000_000
BLOCK_BYTES = 16_000_000
#: A list is short when it holds at most one of so many documents of a segment.
SHORT = 16
K = 10
#: Length normalisation in hundredths, and the saturation of term counts in thousandths times ten.
LENGTH_PERCENT = 90
SATURATION = 8

# What separates terms are the ASCII characters that are neither digits nor letters; only A to Z change case.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

SEGMENT = "terms array<string>, sizes array<int>, docs binary, counts binary, ids binary, lengths binary"
FOUND = "query_id long, doc_id long, score long"


def _words(text: bytes) -> list[bytes]:
    """Terms in order. Other white space than the blank cannot be left after the translation, so a plain split is enough."""
    return text.translate(_TABLE).split()


def build_segment(ids: list[int], texts: list[bytes], vocabulary: dict[bytes, int] | None) -> dict:
    """One segment: documents with a term in ascending id, and postings of the vocabulary's terms (of all terms if it is None)."""
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    numbers: dict[bytes, int] = {} if vocabulary is None else vocabulary
    lengths, kept, pairs = [], [], []
    for i in order:
        words = _words(texts[i])
        if not words:
            continue
        if vocabulary is None:
            found = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        else:
            get = vocabulary.get
            found = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            found = found[found >= 0]
        term, count = np.unique(found, return_counts=True)
        pairs.append((term, count))
        kept.append(ids[i])
        lengths.append(len(words))
    if pairs:
        term = np.concatenate([t for t, _ in pairs])
        count = np.concatenate([c for _, c in pairs])
        doc = np.repeat(np.arange(len(pairs)), [len(t) for t, _ in pairs])
    else:
        term = count = doc = np.zeros(0, np.int64)
    by_term = np.argsort(term, kind="stable")
    present, starts = np.unique(term[by_term], return_index=True)
    names = list(numbers)
    return {
        "terms": [names[t].decode() for t in present.tolist()],
        "sizes": np.diff([*starts.tolist(), len(term)]).tolist(),
        "docs": doc[by_term].astype("<i4").tobytes(),
        "counts": count[by_term].astype("<i4").tobytes(),
        "ids": np.array(kept, "<i8").tobytes(),
        "lengths": np.array(lengths, "<i8").tobytes(),
    }


def build_index(docs: DataFrame, vocabulary: list[str] | None, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The stored segments of ``docs``, for the terms of ``vocabulary`` or for all terms. Rows without id take no part."""
    held = docs.sparkSession.sparkContext.broadcast(None if vocabulary is None else {t.encode(): n for n, t in enumerate(vocabulary)})

    def run(batches):
        import pyarrow as pa

        ids, texts, size = [], [], 0

        def segment():
            made = build_segment(ids, texts, held.value)
            kinds = {"terms": pa.list_(pa.string()), "sizes": pa.list_(pa.int32())}
            return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in made.items()], names=list(made))

        for keys, some in chunks(batches, segment_bytes):
            for key, text in zip(keys, some):
                ids.append(key)
                texts.append(text)
                size += len(text)
                if size >= segment_bytes:
                    yield segment()
                    ids, texts, size = [], [], 0
        if ids:
            yield segment()

    rows = only(docs, doc_id=F.col(id_col).cast("long"), text=text_col).filter("doc_id IS NOT NULL")
    return stored(rows.mapInArrow(run, SEGMENT), "lexical-segments")


class Postings:
    """A segment as the search reads it; lists are cut out when first asked for."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.place = {t: i for i, t in enumerate(row["terms"])}
        self.edges = np.concatenate([[0], np.cumsum(row["sizes"])]).astype(np.int64)
        self.docs, self.counts = np.frombuffer(row["docs"], "<i4"), np.frombuffer(row["counts"], "<i4")
        self.ids, lengths = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["lengths"], "<i8")
        self.norm = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * lengths * n_docs) // max(n_terms, 1)
        self.cut: dict[str, tuple] = {}

    def list_of(self, term: str) -> tuple | None:
        """Documents, worth of the term before its weight, and the largest worth; None if no document holds it."""
        found = self.cut.get(term)
        if found is None:
            i = self.place.get(term)
            if i is None:
                return None
            a, b = self.edges[i : i + 2]
            docs, tf = self.docs[a:b], self.counts[a:b].astype(np.int64)
            worth = (1_000_000_000 * tf) // (1000 * tf + SATURATION * self.norm[docs])
            found = self.cut[term] = docs, worth, int(worth.max()), docs.tolist(), worth.tolist()
        return found


def offer(best: list, k: int, score: int, doc: int) -> None:
    """Into the heap of ``(score, -doc)``: higher scores first, ties to the smaller id."""
    if score <= 0:
        return
    item = (score, -doc)
    if len(best) < k:
        heapq.heappush(best, item)
    elif item > best[0]:
        heapq.heapreplace(best, item)


def search(segment: Postings, terms: list[tuple[str, int]], best: list, k: int = K, short: int = SHORT) -> int:
    """The documents of one segment for one query ``(term, weight)``; ``best`` is its heap, filled by earlier segments.

    Returns how many documents were scored.
    """
    lists = [(w, *held) for t, w in terms if w > 0 and (held := segment.list_of(t)) is not None]
    n = len(segment.ids)
    few = [x for x in lists if len(x[1]) * short <= n]
    many = [x for x in lists if len(x[1]) * short > n]
    # Term at a time: the short lists become one list of partial scores.
    if few:
        touched = np.concatenate([x[1] for x in few])
        gained = np.concatenate([x[0] * x[2] for x in few])
        docs, back = np.unique(touched, return_inverse=True)
        partial = np.zeros(len(docs), np.int64)
        np.add.at(partial, back, gained)
    else:
        docs, partial = np.zeros(0, np.int32), np.zeros(0, np.int64)
    # Long lists by falling bound; rest[i] is what the lists from i on can add at most.
    many.sort(key=lambda x: -x[0] * x[3])
    bounds = [x[0] * x[3] for x in many]
    rest = [0] * (len(many) + 1)
    for i in range(len(many) - 1, -1, -1):
        rest[i] = rest[i + 1] + bounds[i]
    least = best[0][0] if len(best) == k else 0
    if len(partial) >= k:
        least = max(least, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
    # The accumulators are an iterator of their own, of which documents out of reach are dropped at once.
    alive = partial + rest[0] >= least
    docs, partial = docs[alive], partial[alive]
    acc_docs, acc = docs.tolist(), partial.tolist()
    top = max(acc, default=0)
    ids = segment.ids
    scored = 0
    # Long lists are essential as long as all behind them, with the best accumulator, do not reach the bar without them.
    at = [0] * len(many)
    a, n_acc = 0, len(acc_docs)

    def essential(bar: int) -> int:
        """How many long lists, by falling bound, a document without accumulator must be in at least one of."""
        e = len(many)
        while e and rest[e - 1] < bar:
            e -= 1
        return e

    lead = essential(least)
    ends = [len(x[4]) for x in many]
    while True:
        doc = acc_docs[a] if a < n_acc else n
        for i in range(lead):
            if at[i] < ends[i] and many[i][4][at[i]] < doc:
                doc = many[i][4][at[i]]
        if doc == n:
            break
        score = 0
        if a < n_acc and acc_docs[a] == doc:
            score = acc[a]
            a += 1
        bar = max(least, best[0][0] if len(best) == k else 0)
        hopeless = False
        for i, (w, _, _, _, places, worth) in enumerate(many):
            if score + rest[i] < bar:
                hopeless = True
                # Essential lists step past the document even if it is given up.
                for j in range(i, lead):
                    if at[j] < ends[j] and many[j][4][at[j]] == doc:
                        at[j] += 1
                break
            p = at[i]
            if p < ends[i] and places[p] < doc:
                p = at[i] = bisect_left(places, doc, p)
            if p < ends[i] and places[p] == doc:
                score += w * worth[p]
                at[i] += 1
        if hopeless:
            continue
        scored += 1
        if score >= bar:
            offer(best, k, score, int(ids[doc]))
            if len(best) == k and best[0][0] > least:
                least = best[0][0]
                lead = essential(least)
                while a < n_acc and acc[a] + rest[0] < least:
                    a += 1
    return scored


def weights(frequency: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def rank(
    docs: DataFrame,
    queries: DataFrame,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_col: str = "item_id",
    query_text_col: str = "text",
    short: int = SHORT,
    segment_bytes: int = SEGMENT_BYTES,
    vocabulary_bytes: int = VOCABULARY_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``query_id, rank, doc_id, score``: the ``k`` documents with the highest score above 0 for each query, ties to the smaller id.

    Null texts have no terms. Rows without id take no part. Rows that repeat a document's id are one document each in all counts and may both
    be ranked. Of queries that repeat an id the smallest text counts. A query without a term that any document holds has no rows.
    """
    asked = _queries(queries, query_col, query_text_col)
    total = asked.agg(F.sum("bytes").alias("bytes")).first().bytes or 0
    vocabulary = asked.select(F.explode("terms").alias("term")).distinct()
    size = vocabulary.agg(F.sum(F.octet_length("term") + 100).alias("bytes")).first().bytes or 0
    names = sorted(r.term for r in vocabulary.collect()) if size <= vocabulary_bytes else None
    index = build_index(docs, names, id_col, text_col, segment_bytes)
    n_docs, n_terms = _totals(index)
    frequency = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.sizes").alias("df"))
    held = asked.select("query_id", F.explode("terms").alias("term")).join(frequency, "term")
    listed = held.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "df"))).alias("terms"))
    blocks = max(1, -(-total // block_bytes))
    listed = stored(listed.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "lexical-queries")
    out = None
    for b in range(blocks):
        block = [(r.query_id, [(t.term, weights(t.df, n_docs)) for t in r.terms]) for r in listed.filter(F.col("block") == b).collect()]
        found = _search_block(index, block, n_docs, n_terms, k, short)
        out = found if out is None else out.union(found)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _queries(queries: DataFrame, query_col: str, text_col: str) -> DataFrame:
    """``query_id, terms, bytes``, stored: each query's different terms."""

    def run(batches):
        import pyarrow as pa

        for keys, texts in chunks(batches):
            terms = [sorted({w.decode() for w in _words(t)}) for t in texts]
            sizes = [sum(len(t) + 60 for t in found) for found in terms]
            columns = [pa.array(keys, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "terms", "bytes"])

    rows = only(queries, query_id=F.col(query_col).cast("long"), text=text_col).filter("query_id IS NOT NULL")
    one = rows.groupBy("query_id").agg(F.min("text").alias("text"))
    return stored(one.mapInArrow(run, "query_id long, terms array<string>, bytes long"), "lexical-terms")


def _totals(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lengths = [np.frombuffer(x, "<i8") for x in batch.column("lengths").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, lengths))], pa.int64()), pa.array([int(sum(x.sum() for x in lengths))], pa.int64())], names=["n", "l"])

    row = index.select("lengths").mapInArrow(run, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return row.n or 0, row.l or 0


def _search_block(index: DataFrame, block: list, n_docs: int, n_terms: int, k: int, short: int) -> DataFrame:
    """``query_id, doc_id, score``: the best ``k`` documents of each task for each query of the block."""
    sent = index.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_BYTES of terms

    def run(batches):
        import pyarrow as pa

        best: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Postings(batch.slice(i, 1).to_pylist()[0], n_docs, n_terms)
                for query, terms in sent.value:
                    search(segment, terms, best.setdefault(query, []), k, short)
        found = [(query, -doc, score) for query, heap in best.items() for score, doc in heap]
        columns = zip(*found) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "doc_id", "score"])

    return index.mapInArrow(run, FOUND)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("query_id", "item_id")


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY term, doc_id),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
s AS (
  SELECT item_id, p.doc_id, sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN f USING (term) JOIN d ON d.doc_id = p.doc_id, a
  GROUP BY item_id, p.doc_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

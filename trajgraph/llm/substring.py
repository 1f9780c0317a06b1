"""Removal of long repeated word sequences by recompression.

A window is ``window`` consecutive words of one document. A word is removed when a window that covers it also starts in a document with a
smaller id.

Recompression rounds rename a document's symbols, words at first: equal neighbours become one symbol for the run, then every neighbouring
pair of a left and a right symbol becomes one; whether a symbol is left or right follows from its name, and a new name from the names it
stands for. Names are therefore the same in every document and task, and equal substrings get equal symbols inside, whatever stands
around them. The steps:

1. Long repeats. Symbols of a high level that span a window at least go to Spark with a 128-bit digest of their words. One that also
   occurs in a document with a smaller id covers all its words at once; this takes in copies and long passages with few rows.
2. Candidates. A window with an uncovered word is open. Of the symbols of level ``low_rounds`` inside a window whose surroundings, inside
   the window too, determine them, the one with the smallest name stands for the window: its key. Equal windows have equal keys. A window
   without such a symbol (one run of words) has its own digest as its key. Spark finds the keys of open windows that a smaller document
   has as well.
3. Verification. Only windows with such a key go to Spark, with a 96-bit digest of their words; those found in a smaller document cover
   their words.

Texts are shuffled once, compressed, by document; the exchange serves every later pass. Keys and window digests go to their owners once. What
many documents share is settled inside each chunk of some hundred documents first, where one row is left for each key or digest, so a
passage that a third of all documents hold is a few rows a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_value, only, stored, table
from .words import chunks

by_value(__name__)

WINDOW = 13
#: Rounds that name the symbols of long repeats: a symbol spans some 100 words.
HIGH_ROUNDS = 16
#: Bytes of text handled at once: a chunk takes some 60 bytes for each of them.
CHUNK = 2_000_000

_U = np.uint64
# The multipliers of a known 64-bit finaliser and two odd bases of rolling digests.
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def low_rounds(window: int) -> int:
    """The most rounds after which every window without runs still holds a symbol that its own words determine."""
    k = 0
    while 2 * (2 ** (k + 1) - 1) + 2 ** (k + 2) - 1 <= window:
        k += 1
    return k


def compress(names: np.ndarray, start: np.ndarray, doc: np.ndarray, round_: int):
    """One round: names runs, then left-right pairs, never across documents."""
    n = len(names)
    if not n:
        return names, start, doc
    new = np.ones(n, bool)
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, n)).astype(_U)
    base, start, doc = names[first], start[first], doc[first]
    run = np.where(length > 1, mix(base + mix(length)), base)
    left = (mix(base ^ mix(np.full(1, round_ + 1, _U))) & _U(1)).astype(bool)
    pair = left[:-1] & ~left[1:] & (doc[:-1] == doc[1:])
    named = run.copy()
    at = np.flatnonzero(pair)
    named[at] = mix(mix(run[at]) + run[at + 1] * _M2)
    keep = np.ones(len(run), bool)
    keep[1:] = ~pair
    return named[keep], start[keep], doc[keep]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASES[0]))
_POWERS: dict = {}


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For both bases at least ``n`` powers and as many of the inverse, kept between chunks of a task."""
    if not _POWERS or len(_POWERS["held"][0][0]) < n:
        step = lambda x: np.cumprod(np.concatenate([[_U(1)], np.full(n, x, _U)]), dtype=_U)
        _POWERS["held"] = [(step(base), step(pow(base, -1, 1 << 64))) for base in _BASES]
    return _POWERS["held"]


class Chunk:
    """The words of several documents in one array, with digests of any span.

    A digest is a polynomial over 64 bits in an odd base, so that prefix sums give it for every span; it is hashed with the span's size.
    """

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
        space = _SPACE[raw]
        first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        last = np.flatnonzero(~space[:-1] & space[1:]) + 1
        up, down = powers(len(raw) + 1)[0]
        total = np.zeros(len(raw) + 1, _U)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
        self.hash = mix((total[last] - total[first]) * down[first] + (last - first).astype(_U))
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        borders = np.searchsorted(first, offsets)
        self.starts, self.ends = borders[:-1], borders[1:]
        self.doc = np.repeat(np.arange(len(texts)), self.ends - self.starts)

    def __len__(self):
        return len(self.doc)

    def digest(self, at: np.ndarray, size: np.ndarray | int, stream: int = 0) -> np.ndarray:
        """A 64-bit digest of each span; spans of equal words are equal wherever they stand. The streams differ in base and words."""
        up, down = powers(len(self) + 1)[stream]
        words = mix(self.hash + _M2) if stream else self.hash
        total = np.zeros(len(self) + 1, _U)
        np.cumsum(words * up[: len(words)], out=total[1:])
        size = np.asarray(size)
        return mix((total[at + size] - total[at]) * down[at] + size.astype(_U))

    def symbols(self, rounds: int):
        levels = [(self.hash, np.arange(len(self)), self.doc)]
        for k in range(rounds):
            levels.append(compress(*levels[-1], k))
        return levels

    def long_symbols(self, rounds: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, sizes and names of the symbols of the last round that span a window at least."""
        level = (self.hash, np.arange(len(self)), self.doc)
        for k in range(rounds):
            level = compress(*level, k)
        names, start, _ = level
        end = np.append(start[1:], len(self))
        wide = end - start >= window
        return start[wide], (end - start)[wide], names[wide]

    def windows(self, window: int) -> np.ndarray:
        """Starts of all windows."""
        if len(self) < window:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: len(self) - window + 1] == self.doc[window - 1 :])

    def keys(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows, and the key of each."""
        at = self.windows(window)
        best = np.full(len(self) + 1, _NONE)
        rounds = low_rounds(window)
        if len(at) and rounds:
            levels = self.symbols(rounds)
            a, b, key = _determined(self, levels)
            lo, hi = b - window + 1, a - 1
            # The windows a symbol may stand for start at lo to hi; symbols differ in lo, so a step writes no place twice.
            for step in range(window):
                some = lo + step <= hi
                if step and not some.any():
                    break
                lo, hi, key = lo[some], hi[some], key[some]
                place = lo + step
                inside = place >= 0
                place, mine = place[inside], key[inside]
                best[place] = np.minimum(best[place], mine)
        found = best[at]
        alone = found == _NONE
        if alone.any():
            found[alone] = self.digest(at[alone], window)
        return at, found


def _determined(chunk: Chunk, levels) -> tuple[np.ndarray, ...]:
    """The words ``[a - 1, b]`` that determine a symbol of the last level, and its key, for all symbols.

    One level below, a symbol's borders follow from the symbols on both sides, whose own far borders follow from one more word (or, at
    deeper levels, from one more symbol each); a symbol whose surroundings reach over the document's ends is left out.
    """
    names, p, doc = levels[-1]
    q = np.append(p[1:], len(chunk))
    key = names
    a, b = p, q
    good = np.ones(len(p), bool)
    first, last = chunk.starts[doc], chunk.ends[doc]
    for below, start, _ in reversed(levels[1:-1]):
        left = np.searchsorted(start, a)
        right = np.searchsorted(start, b)
        good &= (a > first) & (b < last)
        left, right = np.maximum(left - 1, 0), np.minimum(right, len(start) - 1)
        key = mix(mix(below[left] + key) + mix(below[right]) * _M1)
        a, b = start[left], np.append(start[1:], len(chunk))[right]
    good &= (a > first) & (b < last)
    a, b, key = a[good], b[good], key[good]
    words = chunk.hash
    key = mix(mix(words[a - 1] + key) + words[b] * _M2)
    return a, b, key


class Spans:
    """The spans found to be repeats so far, of all documents of a chunk: which words they cover, and which windows lie inside one."""

    def __init__(self, chunk: Chunk, lists, window: int):
        coded, doc = _flat(lists)
        at, size = chunk.starts[doc] + (coded >> 32), coded & 0xFFFFFFFF
        n = len(chunk)
        self.covered = _marked(n, at, at + size)
        self.inside = _marked(n, at, at + size - window + 1)


def _marked(n: int, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    change = np.bincount(first, minlength=n + 1) - np.bincount(stop, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """All values of an Arrow column of lists, nulls as empty, and the row of each."""
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    return np.asarray(lists.flatten()), np.repeat(np.arange(len(lists)), sizes)


def _row(ids: list, texts: list[bytes]) -> np.ndarray:
    """A number for each row, from its id and text; rows equal in both share it."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(t, (i or 0) & 0xFFFFFFFFFFFFFFFF) for i, t in zip(ids, texts)], _U).view(np.int64)


#: Stands for no document.
_NOBODY = np.iinfo(np.int64).min


def _by_key(key: np.ndarray, doc_id: np.ndarray, is_open: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different (key, document) pairs in order, with the document's id again where one of its windows is open."""
    order = np.lexsort((~is_open, doc_id, key))
    key, doc_id, is_open = key[order], doc_id[order], is_open[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc_id[1:] != doc_id[:-1])
    key, doc_id, is_open = key[new], doc_id[new], is_open[new]
    return key, doc_id, np.where(is_open, doc_id, _NOBODY)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a new key begins in ordered keys, and the number of each row's group."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _tag(part) -> np.ndarray:
    """Twenty-three bits of each row's number, carried beside its windows."""
    return np.asarray(part.column("row")) & (1 << 23) - 1


def _rows(pa, **columns):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, high_rounds: int = HIGH_ROUNDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` per row; ``kept`` holds the words left, joined by one space.

    Null texts have no words. Windows are judged on the input. Rows with equal id never remove each other's words, a row without id
    neither removes nor loses words, and a text shorter than a window stays whole.
    """
    return _remove(docs, id_col, text_col, window, high_rounds, digest=False)


def _remove(docs, id_col, text_col, window, high_rounds, digest):
    spark = docs.sparkSession
    rows = only(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) doc_id", "text")

    def signed(x):
        return x.view(np.int64)

    def fold(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=6)
        for keys, texts in chunks(batches):
            row = _row(keys, texts)
            place = [r if k is None else k for k, r in zip(keys, row.tolist())]
            yield _rows(pa, place=pa.array(place, pa.int64()), doc_id=pa.array(keys, pa.int64()), row=row, packed=pa.array([pack.compress(t) for t in texts], pa.binary()))

    def long_rows(batches):
        import pyarrow as pa

        for keys, texts in chunks(batches, CHUNK):
            chunk = Chunk([t if k is not None else b"" for k, t in zip(keys, texts)])
            at, size, name = chunk.long_symbols(high_rounds, window)
            doc = chunk.doc[at]
            ids = np.array([0 if k is None else k for k in keys], np.int64)
            span = (at - chunk.starts[doc]) << 32 | size
            yield _rows(pa, name=signed(name), digest=signed(chunk.digest(at, size)), doc_id=ids[doc], row=_row(keys, texts)[doc], span=span)

    symbols = rows.mapInArrow(long_rows, "name long, digest long, doc_id long, row long, span long")
    seen = symbols.groupBy("name", "digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    covers = symbols.join(seen.drop("most"), ["name", "digest"]).filter("doc_id > least")
    covers = stored(covers.groupBy(F.col("doc_id").alias("place"), F.col("row").alias("of")).agg(F.collect_set("span").alias("spans")), "long-repeats")

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows go to the place of their id; rows without one are spread, as nothing is ever joined to them.
    texts = rows.mapInArrow(fold, "place long, doc_id long, row long, packed binary").repartition(n, "place")
    both = _beside(texts, covers).select("place", "doc_id", "row", "packed", "spans")

    def read(batches):
        """Parts of Arrow batches with their texts, of bounded size."""
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            at, held, size = 0, [], 0
            for i, packed in enumerate(batch.column("packed").to_pylist()):
                held.append(unpack.decompress(packed))
                size += len(held[-1])
                if size >= CHUNK or i + 1 == batch.num_rows:
                    yield batch.slice(at, len(held)), held
                    at, held, size = i + 1, [], 0

    def opened(part, texts):
        """The chunk, the starts of its windows that may be first or last of their kind, their keys, and which have an uncovered word.

        A window inside one of the spans also starts in a smaller document, where it is not inside such a span or again in a smaller one:
        so it is never the first of its kind, and all of its words are covered.
        """
        chunk = Chunk([t if i is not None else b"" for i, t in zip(part.column("doc_id").to_pylist(), texts)])
        found = Spans(chunk, part.column("spans"), window)
        at, key = chunk.keys(window)
        free = ~found.inside[at]
        at, key = at[free], key[free]
        bare = np.concatenate([[0], np.cumsum(~found.covered)])
        return chunk, at, key, bare[at + window] > bare[at]

    def candidates(batches):
        import pyarrow as pa

        for part, texts in read(batches):
            chunk, at, key, is_open = opened(part, texts)
            if not len(at):
                continue
            doc_id = np.asarray(part.column("doc_id").fill_null(0))[chunk.doc[at]]
            key, doc_id, opened_by = _by_key(key, doc_id, is_open)
            first, group = _groups(key)
            least = doc_id[first]
            most = np.maximum.reduceat(opened_by, first)
            # Of a key that several documents of the chunk hold one row goes to its owner, and each of them asks for its windows anyway.
            many = np.maximum.reduceat(doc_id, first) > least
            shared = many[group]
            yield _rows(pa, slot=signed(key[first]), doc_id=least, open_id=pa.array(most, mask=most == _NOBODY), local=pa.nulls(len(first), pa.int64()))
            key, doc_id = key[shared], doc_id[shared]
            spread = signed(mix(key + mix(doc_id.astype(_U))))
            yield _rows(pa, slot=spread, doc_id=doc_id, open_id=pa.nulls(len(key), pa.int64()), local=signed(key))

    keys = both.mapInArrow(candidates, "slot long, doc_id long, open_id long, local long")
    owner = W.partitionBy("slot")
    keys = keys.withColumns({"least": F.min("doc_id").over(owner), "most": F.max("open_id").over(owner)})
    keys = keys.filter("local IS NOT NULL OR least < most").select(F.col("doc_id").alias("place"), F.coalesce("local", "slot").alias("key"))
    hits = keys.groupBy("place").agg(F.collect_set("key").alias("keys"))

    def verify(batches):
        import pyarrow as pa

        for part, texts in read(batches):
            chunk, at, key, is_open = opened(part, texts)
            doc = chunk.doc[at]
            wanted_key, wanted_doc = _flat(part.column("keys"))
            # Both sides as one number: a false meeting of two of them only sends one more window.
            mine = mix(key + mix(doc.astype(_U)))
            chosen = np.isin(mine, mix(wanted_key.view(_U) + mix(wanted_doc.astype(_U))))
            at, doc, is_open = at[chosen], doc[chosen], is_open[chosen]
            one, two = (signed(chunk.digest(at, window, stream)) for stream in (0, 1))
            doc_id = np.asarray(part.column("doc_id").fill_null(0))[doc]
            at = _tag(part)[doc] << 40 | at - chunk.starts[doc]
            order = np.lexsort((doc_id, two, one))
            one, two, doc_id, at, is_open = (x[order] for x in (one, two, doc_id, at, is_open))
            new = np.ones(len(one), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            least = doc_id[np.flatnonzero(new)][np.cumsum(new) - 1] if len(one) else doc_id
            # Found in a smaller document of the same chunk: settled here. The smallest one's windows go to the digest's owner.
            settled = is_open & (doc_id > least)
            asks = doc_id == least
            yield _rows(pa, h1=one[asks], h2=two[asks].astype(np.int32), doc_id=doc_id[asks], at=pa.array(at[asks], mask=~is_open[asks]), local=pa.array(np.zeros(int(asks.sum()), bool)))
            spread = signed(mix(at[settled].astype(_U) + mix(doc_id[settled].astype(_U))))
            yield _rows(pa, h1=spread, h2=two[settled].astype(np.int32), doc_id=doc_id[settled], at=at[settled], local=pa.array(np.ones(len(spread), bool)))

    found = both.join(hits, "place").mapInArrow(verify, "h1 long, h2 int, doc_id long, at long, local boolean")
    owner = W.partitionBy("h1", "h2")
    repeats = found.withColumn("least", F.min("doc_id").over(owner)).filter("at IS NOT NULL AND (local OR doc_id > least)")
    repeats = repeats.groupBy(F.col("doc_id").alias("place")).agg(F.collect_set("at").alias("windows"))

    def remove(batches):
        import pyarrow as pa

        for part, texts in read(batches):
            words = [t.split() for t in texts]
            starts = np.cumsum([0, *map(len, words)])
            wide, wide_doc = _flat(part.column("spans"))
            narrow, narrow_doc = _flat(part.column("windows"))
            mine = narrow >> 40 == _tag(part)[narrow_doc]
            narrow, narrow_doc = narrow[mine] & (1 << 40) - 1, narrow_doc[mine]
            first = np.concatenate([starts[wide_doc] + (wide >> 32), starts[narrow_doc] + narrow])
            size = np.concatenate([wide & 0xFFFFFFFF, np.full(len(narrow), window)])
            gone = _marked(int(starts[-1]), first, first + size)
            lost = np.add.reduceat(np.append(gone, False), starts[:-1]) if len(gone) else np.zeros(len(words), int)
            lost = np.where(starts[1:] > starts[:-1], lost, 0)
            kept = []
            for mine, at, less in zip(words, starts.tolist(), lost.tolist()):
                if less:
                    mine = [w for w, g in zip(mine, gone[at : at + len(mine)].tolist()) if not g]
                text = b" ".join(mine)
                kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            yield _rows(pa, doc_id=part.column("doc_id"), n_words=np.diff(starts), n_removed=lost.astype(np.int64), kept=pa.array(kept, pa.string()))

    last = both.join(repeats, "place", "left")
    return last.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


def _beside(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """``rows`` with the lists of their place; rows of one id but different texts are told apart by the row number.

    Only the place is an equi key, so the one exchange of the texts serves all joins.
    """
    same_row = (rows["row"] <= lists["of"]) & (rows["row"] >= lists["of"])
    return rows.join(lists, (rows["place"] == lists["place"]) & same_row, "left").drop(lists["place"])


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _remove(table(spark, sf_dir, "documents"), "doc_id", "text", WINDOW, HIGH_ROUNDS, digest=True)
    return found.withColumnRenamed("kept", "kept_sha256")


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
s AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)
),
f AS (SELECT win, min(doc_id) AS least FROM s GROUP BY win),
r AS (SELECT DISTINCT s.doc_id, s.i + k AS place FROM s JOIN f USING (win), (SELECT unnest(range(0, 13)) AS k) WHERE f.least < s.doc_id),
g AS (SELECT doc_id, list(place) AS gone FROM r GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string([words[j] FOR j IN range(1, len(words) + 1) IF NOT list_contains(coalesce(gone, []), j)], ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""

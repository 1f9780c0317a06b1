"""The pipeline's near-duplicate stage: SimHash links and min-hash bands bring texts together, exact shingle similarity decides.

A text is the set of its five-word shingles; two texts are linked when their sets have a Jaccard similarity of 0.8 or more. Candidates come
from two sides. Fingerprints of the same shingles within two bits are found by multi-index hashing (:mod:`simhash`). Such a small radius
misses most pairs near 0.8, so each set also has ``BANDS`` keys of ``ROWS`` minimum hashes: two sets of similarity ``s`` share a key with
probability ``1 - (1 - s**ROWS)**BANDS``, which is 0.9998 at 0.8 and more above. Every candidate pair is verified by its complete sets.

A group of texts that share a key is compared with one of its members first, the one with most company in all of its groups. Texts that
are then still apart from others of a group are mostly alike in some passages only, so they are grouped anew, by sizes and by their rarest
shingles, of which two similar sets must share one (:func:`_rarest`). These groups are compared with one member, then, as far as they are
not connected yet, with 8, 64 and more of them, until each group is one component or every member has been compared with all others. So no
connection that a candidate pair would give is lost, the work of a group of near copies is in proportion to it, and texts that differ in
more than similar ones can are hardly compared.

Equal sets are one node. Only keys and the sets of candidates are shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, fresh, only, stored
from .components import components
from .simhash import fingerprint, link
from .words import chunks

by_value(__name__)

WORDS = 5
#: The least similarity as a fraction, so that it is compared in whole numbers.
LEAST = (4, 5)
SEED = 42
BANDS = 36
ROWS = 7
#: Bytes of text whose sets a task holds at once.
CHUNK = 1_000_000
#: Counters of the sets that hold a shingle. Shingles share them by hash; the fewer there are, the less is known to be rare.
COUNTERS = 1 << 18
#: Bits of the filter that tells which texts to read again; beyond this size it only lets more texts through.
FILTER_BITS = 1 << 27


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """The different shingle hashes of a text, ascending; a shorter text is one shingle, and one without words has none."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.int64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(w) for w in parts]) + np.arange(len(parts))
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64).view(np.int64))


def node_of(found: np.ndarray) -> int:
    """The signed name of a set; equal sets are one node."""
    import xxhash

    value = xxhash.xxh64_intdigest(found.tobytes(), SEED)
    return value - (1 << 64) if value >> 63 else value


def band_keys(found: np.ndarray, factors: np.ndarray, block: int = 512) -> np.ndarray:
    """One key for each band: a mix of the minima of ``ROWS`` hash functions, those of the odd ``factors``."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    hashes = found.view(np.uint64)
    for at in range(0, len(hashes), block):
        part = hashes[at : at + block, None]
        mixed = (part ^ (part >> np.uint64(31))) * factors
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ rows[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        key = key ^ (key >> np.uint64(29))
    return key.view(np.int64)


def _factors() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)


def _signatures(rows: DataFrame) -> DataFrame:
    """``doc_id, node, size, fp, keys`` per row: name and size of the set, its fingerprint and its band keys (none for an empty set)."""

    def run(batches):
        import pyarrow as pa

        factors = _factors()
        for ids, texts in chunks(batches, CHUNK):
            sets = [shingle_set(t) for t in texts]
            prints = np.array([fingerprint(t, WORDS, SEED) for t in texts], np.uint64).view(np.int64)
            keys = [band_keys(s, factors) if len(s) else np.zeros(0, np.int64) for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
            columns = [pa.array(ids, pa.int64()), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prints), lists], names=["doc_id", "node", "size", "fp", "keys"])

    return rows.mapInArrow(run, "doc_id long, node long, size int, fp long, keys array<long>")


def _sets(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``node, shingles`` of the rows whose id is one of ``ids(doc_id)``, and of some others that share a bit of the filter.

    The filter is at most ``FILTER_BITS`` bits, so texts are read where they lie and only sets are shuffled.
    """
    bits = min(FILTER_BITS, 64 * -(-(16 * max(1, ids.count())) // 64))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    one = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    marked = ids.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[marked.column("at").to_numpy()] = marked.column("bits").to_numpy()
    held = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        import pyarrow as pa

        for slots, texts in chunks(batches, CHUNK):
            texts = [t for s, t in zip(slots, texts) if int(held.value[s >> 6]) >> (s & 63) & 1]
            for at in range(0, len(texts), 256):
                sets = [shingle_set(t) for t in texts[at : at + 256]]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), lists], names=["node", "shingles"])

    return rows.select(slot.alias("slot"), "text").mapInArrow(run, "node long, shingles array<long>")


def _sizes_fit(a: str, b: str):
    top, bottom = LEAST
    return (F.col(a) * bottom >= F.col(b) * top) & (F.col(b) * bottom >= F.col(a) * top)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the different ``pairs(src, dst)`` of nodes that are similar."""
    top, bottom = LEAST
    left, right = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"{k}_set")) for k in ("src", "dst"))
    both = pairs.join(left.hint("merge"), "src").join(right.hint("merge"), "dst")
    shared = F.size(F.array_intersect("src_set", "dst_set"))
    return both.filter(shared * bottom >= (F.size("src_set") + F.size("dst_set") - shared) * top).select("src", "dst")


def _centres(posted: DataFrame, count: int) -> DataFrame:
    """``key, centre, centre_size, centre_component``: up to ``count`` members at home in each key's group in ``posted(key, node, size, weight, home, component)``.

    The members are dealt by a hash and each deal gives the one of the largest weight, so a group of any size is combined before its shuffle.
    """
    deal = F.pmod(F.xxhash64("node"), F.lit(count))
    order = F.struct((-F.col("weight")).alias("w"), F.xxhash64("node", F.lit(1)).alias("h"), "node", "size", "component")
    least = posted.filter("home").groupBy("key", deal.alias("deal")).agg(F.min(order).alias("c"))
    return least.select("key", F.col("c.node").alias("centre"), F.col("c.size").alias("centre_size"), F.col("c.component").alias("centre_component"))


def _pairs(posted: DataFrame, centres: DataFrame) -> DataFrame:
    """``src, dst`` of the members of each key's group and its centres, as far as they are not connected and their sizes fit."""
    met = posted.join(centres.hint("merge"), "key").filter((F.col("component") != F.col("centre_component")) & _sizes_fit("size", "centre_size"))
    return met.select(F.least("node", "centre").alias("src"), F.greatest("node", "centre").alias("dst")).distinct()


def _apart(posted: DataFrame) -> DataFrame:
    """The rows of ``posted(key, node, size, weight, home, component)`` whose group holds several components and someone at home."""
    ends = [F.min("component").alias("low"), F.max("component").alias("high"), F.max("home").alias("some")]
    apart = posted.groupBy("key").agg(*ends).filter("low <> high AND some").select("key")
    return posted.join(apart.hint("merge"), "key", "left_semi").select("key", "node", "size", "weight", "home", "component")


def _classes(most: int) -> np.ndarray:
    """The least sizes of the classes of sizes up to ``most``, each a twentieth wide."""
    least = [0, 1]
    while least[-1] <= most:
        least.append(max(least[-1] + 1, least[-1] * 21 // 20))
    return np.array(least, np.int64)


def rare_keys(found: np.ndarray, counts: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys by which a set meets every similar set, and whether each is one of its own class of sizes; ``least`` is of :func:`_classes`.

    All sets are put in one order, rare shingles first. Two sets of ``n`` and ``m`` shingles that share ``both`` of them hold the first of
    these at a place of at most ``n - both``, and are similar only if ``m`` is at most a share of ``both`` less ``n``. So each place of a set
    has a largest size that it can be the first one shared with. The larger set goes to the classes of the smaller ones.
    """
    top, bottom = LEAST
    n = len(found)
    fewest = -(-top * n // bottom)
    shared = np.arange(n, fewest - 1, -1)  # what a set can have in common with another from each place on
    first = found[np.lexsort((found, counts[found & (len(counts) - 1)]))[: len(shared)]]
    low, own = np.searchsorted(least, [fewest, n], "right") - 1
    high = np.minimum(own, np.searchsorted(least, (top + bottom) * shared // top - n, "right") - 1)
    many = np.maximum(high - low + 1, 0)
    kind = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + low
    keys = np.repeat(first, many).view(np.uint64) ^ ((kind + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return keys.view(np.int64), kind == own


def _rarest(posted: DataFrame, sets: DataFrame) -> DataFrame:
    """The nodes of ``posted`` with their :func:`rare_keys`; how rare a shingle is, is counted among them."""
    nodes = posted.select("node", "size", "weight", "component").distinct()
    sets = sets.join(nodes.select("node").hint("merge"), "node", "left_semi")
    slot = F.col("shingle").bitwiseAND(COUNTERS - 1)
    counted = sets.select(F.explode("shingles").alias("shingle")).groupBy(slot.alias("at")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[counted.column("at").to_numpy()] = counted.column("n").to_numpy()
    held = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [s.values.to_numpy() for s in batch.column(1)]
            least = _classes(max(map(len, found), default=0))
            keys = [rare_keys(s, held.value, least) for s in found]
            owners = np.repeat(batch.column(0).to_numpy(), [len(k) for k, _ in keys])
            columns = [pa.array(owners, pa.int64()), *(pa.array(np.concatenate(c)) for c in zip(*keys))]
            if keys:
                yield pa.RecordBatch.from_arrays(columns, names=["node", "key", "home"])

    keys = sets.select("node", "shingles").mapInArrow(run, "node long, key long, home boolean")
    return keys.join(nodes.hint("merge"), "node")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` per row: the smallest id among the documents reachable over links, the document itself included.

    Null texts count as empty, and texts without words are one group. Null ids are never a component's id unless it has no other.
    """
    rows = only(docs, doc_id=F.col(id_col).cast("long"), text=text_col)
    prints = stored(_signatures(rows), "near-signatures")
    first = prints.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("size").alias("size"), F.min("fp").alias("fp"))
    first = stored(first, "near-nodes")
    # Keys of one node only bring nobody together.
    posted = prints.select("node", "size", F.explode("keys").alias("key"))
    shared = posted.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("many"))
    posted = stored(posted.join(shared.filter("low <> high").select("key", "many").hint("merge"), "key").distinct(), "near-postings")
    # A text that stands in many large groups is most likely what the others of those groups were copied from, so it is compared first.
    weight = posted.groupBy("node").agg(F.sum("many").alias("weight"))
    posted = posted.drop("many").join(weight.hint("merge"), "node").select("key", "node", "size", "weight", F.lit(True).alias("home"))
    # A fingerprint stands for its smallest node, which meets the other nodes of the fingerprint and the nodes of linked fingerprints.
    by_print = first.groupBy("fp").agg(F.min("node").alias("centre"), F.max("node").alias("high"))
    spread = by_print.select("fp").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    links = stored(link(spread), "near-fingerprints")
    # Merged and not broadcast: each of these has a row for a text or a link.
    ends = by_print.select("fp", "centre").hint("merge")
    near = links.join(ends.select(F.col("fp").alias("src"), F.col("centre").alias("a")), "src").join(ends.select(F.col("fp").alias("dst"), F.col("centre").alias("b")), "dst")
    same = first.join(by_print.filter("centre <> high").select("fp", "centre").hint("merge"), "fp").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    close = near.select("a", "b").union(same).filter("a <> b")
    sizes = first.select("node", "size").hint("merge")
    close = close.join(sizes.select(F.col("node").alias("a"), F.col("size").alias("a_size")), "a").join(sizes.select(F.col("node").alias("b"), F.col("size").alias("b_size")), "b")
    close = close.filter(_sizes_fit("a_size", "b_size")).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))

    posted = stored(posted.withColumn("component", F.col("node")), "near-postings")
    wanted = stored(posted.select("node").union(close.select("src")).union(close.select("dst")).distinct(), "near-wanted")
    sets = _sets(rows, first.join(wanted, "node", "left_semi").select("doc_id")).join(wanted, "node", "left_semi")
    sets = stored(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "near-sets")
    done = found = close.limit(0)
    groups = None
    turn, extra = 0, close
    while True:
        centres = stored(_centres(posted, 8 ** max(0, turn - 1)), "near-centres")
        pairs = stored(_pairs(posted, centres).union(extra).distinct().join(done.hint("merge"), ["src", "dst"], "left_anti"), "near-pairs")
        more = stored(_similar(pairs, sets), "near-links")
        found = found.union(more)
        if groups is None or not more.isEmpty():
            groups = components(found)
        # A centre has been compared with all of its group and leaves it; groups go on that still hold several components.
        posted = posted.drop("component").join(centres.select("key", F.col("centre").alias("node")).hint("merge"), ["key", "node"], "left_anti")
        posted = posted.join(groups.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        posted = stored(_apart(posted), "near-postings")
        if turn == 0:
            posted = stored(_apart(_rarest(posted, sets)), "near-postings")
        if posted.isEmpty():
            break
        done, extra, turn = done.union(pairs), close.limit(0), turn + 1

    labelled = first.select("node", "doc_id").join(groups.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = labelled.join(smallest.hint("merge"), "component").select("node", "component_id")
    return prints.select("doc_id", "node").join(named.hint("merge"), "node").select("doc_id", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group of similar texts; a group of null ids only stays whole."""
    (name,) = fresh(docs, "kept_id")
    groups = similar_groups(docs, id_col, text_col).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = groups.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(name)), "left_semi")

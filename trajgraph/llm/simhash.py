"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint has a bit set where more than half of the XXH64 hashes of its word shingles have it. Two fingerprints are linked
when they differ in at most ``max_distance`` bits. The fingerprint is cut into segments, and each segment has a table of its own: an entry
is a value of the segment with the fingerprints that hold it. Of ``max_distance`` differing bits at most ``max_distance // segments`` fall
into some segment, so a fingerprint finds all others by enumerating the Hamming ball of that radius around its value in each segment,
fetching those entries and verifying the complete distances.

Skew: equal fingerprints are one row. An entry with more than ``HOT`` fingerprints (a large group of near copies shares a segment) is not
fetched. The fingerprints that hold its value or ask for it are looked up among themselves by their whole value with one bit flipped
instead: such a key has at most 65 members, so an entry is one bit mask, combined before the shuffle, and its members become a star.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, fresh, only, stored, table
from .components import components
from .words import chunks

by_value(__name__)

BITS = 64
#: Segments of the fingerprint; each has a table of its own.
SEGMENTS = 2
MAX_DISTANCE = 2
#: An entry of a table with more fingerprints is split by the other segments.
HOT = 64
#: Shingles whose bits are counted at once: 64 bytes each.
BLOCK = 65_536


def fingerprint(text: bytes, shingle_words: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of one text; no words give zero."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) for w in words]) + np.arange(len(words))
    k = min(shingle_words, len(words))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(stops), BLOCK):
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(stops)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` per row, the fingerprint as a signed long; null texts count as empty."""

    def run(batches):
        import pyarrow as pa

        for keys, texts in chunks(batches):
            found = np.array([fingerprint(t, shingle_words, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found)], names=["doc_id", "fp"])

    rows = only(docs, doc_id=id_col, text=text_col)
    return rows.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _tables(prints: DataFrame, segments: int) -> DataFrame:
    """``segment, value, fp``: a row of every segment's table for each fingerprint."""
    width = BITS // segments
    rows = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"))
    value = F.call_function("shiftrightunsigned", F.col("fp"), F.col("segment") * width)
    return rows.select("segment", (value.bitwiseAND((1 << width) - 1) if segments > 1 else F.col("fp")).alias("value"), "fp")


def ball(width: int, radius: int) -> list[int]:
    """The masks of all at most ``radius`` flipped bits among ``width``, as signed longs."""
    found = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def link(prints: DataFrame, segments: int = SEGMENTS, max_distance: int = MAX_DISTANCE, hot: int = HOT) -> DataFrame:
    """Links ``src, dst`` that connect all different fingerprints of ``prints(fp)`` with at most ``max_distance`` (2 at most) differing bits."""
    if BITS % segments or not 0 <= max_distance <= 2:
        raise ValueError("segments divide 64 bits and distances are at most 2")
    table_rows = _tables(prints, segments)
    sizes = table_rows.groupBy("segment", "value").agg(F.count("*").alias("n"))
    large = stored(sizes.filter(F.col("n") > hot).select("segment", "value"), "hot-entries")
    asked = table_rows.withColumn("mask", F.explode(F.array(*map(F.lit, ball(BITS // segments, max_distance // segments)))))
    asked = asked.select("segment", F.col("value").bitwiseXOR(F.col("mask").cast("long")).alias("value"), F.col("fp").alias("src"))
    some = not large.isEmpty()
    small = table_rows.join(large, ["segment", "value"], "left_anti") if some else table_rows
    entries = small.groupBy("segment", "value").agg(F.collect_list("fp").alias("members"))
    # Merged and not broadcast: Spark sizes what a fingerprint asks for as if it were one row, and what is broadcast goes through the driver.
    fetched = asked.join(entries.hint("merge"), ["segment", "value"]).select("src", F.explode("members").alias("dst"))
    distance = F.bit_count(F.col("src").bitwiseXOR(F.col("dst")))
    links = fetched.filter((F.col("src") < F.col("dst")) & (distance <= max_distance)).distinct()
    if some:
        among = asked.join(large, ["segment", "value"], "left_semi").select(F.col("src").alias("fp")).distinct()
        links = links.union(_whole(among).filter(distance <= max_distance))
    return links


def _whole(prints: DataFrame) -> DataFrame:
    """Links within two bits among ``prints(fp)`` by whole values with one bit flipped, a star for every key."""
    variants = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit"))
    one = F.expr("shiftleft(1L, bit)")
    near = variants.select(F.col("fp").bitwiseXOR(one).alias("key"), one.alias("mask"), F.lit(0).alias("self"))
    own = prints.select(F.col("fp").alias("key"), F.lit(0).cast("long").alias("mask"), F.lit(1).alias("self"))
    entry = near.union(own).groupBy("key").agg(F.bit_or("mask").alias("mask"), F.max("self").alias("self"))
    entry = entry.filter(F.bit_count("mask") + F.col("self") > 1)
    flips = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.call_function("getbit", F.col("mask"), b) == 1)
    members = F.concat(
        F.when(F.col("self") == 1, F.array("key")).otherwise(F.array().cast("array<long>")),
        F.transform(flips, lambda b: F.col("key").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))),
    )
    stars = entry.select(members.alias("m")).select(F.array_min("m").alias("src"), F.explode("m").alias("dst"))
    return stars.filter(F.col("src") != F.col("dst")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **shingles) -> DataFrame:
    """``doc_id, fp, component_id`` per row: the smallest id among the documents reachable over links, the document itself included.

    Texts without words share the fingerprint zero. Rows that repeat an id are rows of their own; null ids are never a component's id
    unless the component has no other.
    """
    prints = stored(fingerprints(docs, id_col, text_col, **shingles), "fingerprints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    # A fingerprint becomes 65 rows of the tables, so the few bytes of distinct ones are dealt to all tasks again.
    spread = first.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    groups = components(link(spread)).withColumnRenamed("node", "fp")
    labelled = first.join(groups.hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    named = labelled.join(smallest.hint("merge"), "component").select("fp", "component_id")
    return prints.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their near-duplicate group; a group of null ids only stays whole."""
    (name,) = fresh(docs, "kept_id")
    groups = near_groups(docs, id_col, text_col).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = groups.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(name)), "left_semi")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

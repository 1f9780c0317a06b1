"""Exact dedup over an extendible-hash index kept in shared files.

A 64-bit key (XXH64 of the text) owns a cell of a directory. A bucket is a range of keys that share a prefix. The directory starts two
bits short of the depth that the number of keys asks for; rounds of doubling then split every overfull bucket by one more bit, until each
holds at most ``bucket_keys`` keys or ``max_depth`` is reached.

Copies of one text are combined first, byte by byte, on the map side and where they meet, so a hot group is one row a task. The different
texts are then routed through the directory: a bucket goes to the owner of its range of keys (``repartitionByRange`` over bucket and key),
which chains the texts that share a key, one link each, and writes the chains of its range to the index files. A document finds its text the
same way: its key's prefix gives the cell, the directory the bucket, and key and digest the link of the bucket's chain.

Only the directory is broadcast; it has at most ``2**max_depth`` rows of four numbers.

Main path: DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, only, stored, table, text_of

#: Keys a bucket may hold before it is split.
BUCKET_KEYS = 2048
#: Bits of the largest directory: 2**19 cells of 32 bytes, about 17 MB when broadcast.
MAX_DEPTH = 19


def _prefix(key: Column, bits: int) -> Column:
    """The top ``bits`` bits of a 64-bit key as a number."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def build_directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, int]:
    """Directory cells ``(cell, bucket_depth, bucket, first)`` for ``keys(key)``, and the bits of a cell; ``first`` is a bucket's first cell.

    The cells are counted once at the finest depth; a round only moves cells of overfull buckets one bit deeper.
    """
    keys = stored(keys.select("key").distinct(), "hash-keys")
    start = min(max_depth, max(0, math.ceil(math.log2(max(1, keys.count()) / bucket_keys)) - 2))
    finest = min(max_depth, start + 6)
    cells = keys.groupBy(_prefix(F.col("key"), finest).alias("cell")).agg(F.count("*").alias("n"))
    cells = stored(cells.withColumn("bucket_depth", F.lit(start)), "hash-cells")
    bucket = F.expr("shiftright(cell, {0} - bucket_depth)".format(finest))
    for depth in range(start, finest):
        size = F.sum("n").over(W.partitionBy("bucket_depth", bucket))
        split = (F.col("bucket_depth") == depth) & (size > bucket_keys)
        grown = cells.withColumn("bucket_depth", F.when(split, depth + 1).otherwise(F.col("bucket_depth")))
        grown = stored(grown, "hash-cells")
        cells = grown
        if grown.filter(F.col("bucket_depth") > depth).isEmpty():
            break
    first = F.expr("shiftleft(shiftright(cell, {0} - bucket_depth), {0} - bucket_depth)".format(finest))
    return cells.select("cell", "bucket_depth", bucket.alias("bucket"), first.alias("first")), finest


def routed(rows: DataFrame, directory: DataFrame, bits: int) -> DataFrame:
    """``rows(key, …)`` with the bucket that the directory gives for their key."""
    return rows.withColumn("cell", _prefix(F.col("key"), bits)).join(F.broadcast(directory), "cell").drop("cell")


def build_index(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_keys: int = BUCKET_KEYS,
    max_depth: int = MAX_DEPTH,
    key_bits: int = 64,
) -> DataFrame:
    """Index rows ``(first, bucket_depth, bucket, key, link, sha, keep_id, group_size)``, one per different text.

    The kept row is the one with the largest id; null text counts as empty. ``key_bits`` below 64 shortens the key (tests use it to
    force collisions). Two different texts with equal key and equal SHA-256 raise an error instead of being mixed up.
    """
    return _indexed(docs, id_col, text_col, bucket_keys, max_depth, key_bits)[0]


def _indexed(docs, id_col, text_col, bucket_keys=BUCKET_KEYS, max_depth=MAX_DEPTH, key_bits=64) -> tuple[DataFrame, DataFrame, int]:
    """The index, its directory and the bits of a cell."""
    rows = only(docs, doc=id_col, text=text_of(text_col)).withColumn("key", _key(key_bits))
    directory, bits = build_directory(rows, bucket_keys, max_depth)
    texts = rows.groupBy("key", "text").agg(F.max("doc").alias("keep_id"), F.count("*").alias("group_size"))
    entries = routed(texts.select("key", F.sha2("text", 256).alias("sha"), "keep_id", "group_size"), directory, bits)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owned = entries.repartitionByRange(tasks, "first", "key")
    chain = W.partitionBy("first", "key").orderBy("sha")
    same = F.lag("sha").over(chain) == F.col("sha")
    owned = owned.withColumn("link", F.row_number().over(chain)).withColumn(
        "sha", F.when(same, F.raise_error(F.lit("two texts share key and digest"))).otherwise(F.col("sha"))
    )
    index = owned.select("first", "bucket_depth", "bucket", "key", "link", "sha", "keep_id", "group_size")
    return stored(index.sortWithinPartitions("first", "key", "link"), "hash-index"), directory, bits


def _key(bits: int) -> Column:
    key = F.xxhash64("text")
    return key if bits == 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - bits), 64 - bits)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text is equal to empty text. Rows that repeat an id are rows of their own and all of them are kept or dropped together with
    their text. A null id never wins against another one; a group of null ids only has a null ``keep_id`` and is kept.
    """
    links, directory, bits = _indexed(docs, id_col, text_col, **index)
    links = links.select("first", "key", "sha", "keep_id", "group_size")
    rows = only(docs, doc_id=id_col, text=text_of(text_col)).select(
        "doc_id", _key(index.get("key_bits", 64)).alias("key"), F.sha2("text", 256).alias("sha")
    )
    return routed(rows, directory, bits).join(links, ["first", "key", "sha"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns; of rows equal in id and text one stays.

    The kept text is found by id and digest, so a null id can be kept too.
    """
    name, sha = fresh(docs, "kept_id", "kept_sha")
    same = lambda c: F.concat_ws(":", F.col(c).isNull(), F.col(c).cast("string"))
    kept = build_index(docs, id_col, text_col).select(same("keep_id").alias(name), F.col("sha").alias(sha))
    rows = docs.withColumns({name: same(id_col), sha: F.sha2(text_of(text_col), 256)})
    return rows.join(kept, [name, sha], "left_semi").dropDuplicates([name, sha]).select(*docs.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g USING (text)
"""

"""Queries sent to the parts of an index: each part of the index is shuffled once, and every query once for each part.

A task reads the entries of a part first and then the queries in Arrow batches, so it holds one part of the index and one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value

by_value(__name__)

#: Shards that a part holds at most.
PART_SHARDS = 16


def parts_of(shards: int, tasks: int, part_shards: int = PART_SHARDS) -> int:
    """How many parts ``shards`` shards make: one each while that keeps all tasks busy, bounded parts beyond."""
    return max(1, min(shards, max(tasks, -(-shards // part_shards))))


def meet(index: DataFrame, queries: DataFrame, parts: int, answer: Callable, schema: str) -> DataFrame:
    """Rows that ``answer`` gives for every part of the index and every batch of queries of the same ``width``.

    ``index(width, shard, data)`` has binary entries; a shard lies whole in part ``shard % parts``. ``queries(width, data)`` has one binary
    row for each query. ``answer(entries, queries)`` takes two lists of ``bytes`` and returns an Arrow batch of ``schema``; the list of
    entries is the same object while the part stays the same.
    """
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = index.select("width", (F.col("shard") % parts).cast("int").alias("part"), F.lit(0).alias("kind"), "data")
    right = queries.select("width", part.alias("part"), F.lit(1).alias("kind"), "data")
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.union(right).repartition(max(tasks, parts), "width", "part").sortWithinPartitions("width", "part", "kind")

    def run(batches: Iterator) -> Iterator:
        held: list[bytes] = []
        place = None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                width, here, kind = keys[at]
                rows = batch.column(3).slice(at, end - at).to_pylist()
                if (width, here) != place:
                    place, held = (width, here), []
                if kind == 0:
                    held.extend(rows)
                elif held:
                    yield answer(held, rows)
                at = end

    return dealt.mapInArrow(run, schema)


def rows_of(docs: DataFrame, most: int) -> tuple[int, Column]:
    """Number of shards of at most about ``most`` rows, and the shard of a row by its ``id``."""
    shards = max(1, -(-docs.count() // most))
    return shards, F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")


def packed(*arrays: Column) -> Column:
    """Arrays of longs as little-endian bytes."""
    reverse = lambda h: F.concat(*[F.substring(h, at, 2) for at in range(15, 0, -2)])
    digits = F.transform(F.concat(*arrays), lambda x: reverse(F.lpad(F.hex(x), 16, "0")))
    return F.unhex(F.array_join(digits, ""))

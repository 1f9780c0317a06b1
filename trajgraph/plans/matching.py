"""Ordered matching of a list of targets along a sequence, in one pass.

The state of a sequence is how many targets have been met so far.  A fragment of a
sequence maps every entry state to an exit state, so sequences are cut anywhere:
rows are range-partitioned on (key, order), every partition writes the map of its
fragments, and the few fragments of one key are applied one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_match(hits: DataFrame, key: str, order: str, target: str) -> DataFrame:
    """``key, matched``: how many targets are met in order.

    ``hits(key, order, target)`` lists which targets (from 0) a position meets; a
    position meets one target at most, the next one that is due.  Keys without a hit
    do not come out.
    """
    kind = hits.schema[key].dataType.simpleString()
    parts = max(2, int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = hits.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(target).cast("int").alias("i"))
    ranged = ranged.repartitionByRange(parts, "k", "o").sortWithinPartitions("k", "o")

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, at, due, state = None, None, set(), []
        keys, exits = [], []

        def advance():
            """One position: states that wait for one of its targets move on."""
            nonlocal due
            if due:
                state.extend(range(len(state), max(due) + 2))
                for i, s in enumerate(state):
                    if s in due:
                        state[i] = s + 1
                due = set()

        def finish():
            advance()
            keys.append(held)
            exits.append(state)

        def rows(kind):
            columns = [pa.array(keys, kind), pa.array([part] * len(keys), pa.int32()), pa.array(exits, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["k", "part", "exits"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("k").type
            for k, o, i in zip(*(batch.column(c).to_pylist() for c in ("k", "o", "i"))):
                if at is None or k != held:
                    if at is not None:
                        finish()
                    held, state = k, []
                elif o != at:
                    advance()
                at = o
                due.add(i)
            yield rows(kind)
            keys, exits = [], []
        if at is not None:
            finish()
            yield rows(kind)

    maps = ranged.mapInArrow(fragments, f"k {kind}, part int, exits array<long>")
    # One row per key and partition: never more than there are partitions.
    ordered = maps.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("part", "exits"))).alias("m"))
    run = F.aggregate("m", F.lit(0).cast("long"), lambda s, m: F.coalesce(F.get(m["exits"], s.cast("int")), s))
    return ordered.select(F.col("k").alias(key), run.alias("matched"))

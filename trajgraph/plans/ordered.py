"""Ordered per-group columns that survive a hot group.

``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one task.
That is the right plan while groups are small, and the wrong one when a single
key holds a third of the table.  :func:`ordered_columns` first counts the
largest group (a map-side combined aggregate over the key columns only):

* below the limit (a documented skew parameter, ``trajgraph.window.maxGroupRows``) it
  is a plain window, one shuffle;
* above it rows are range-partitioned on (key, order), so a hot key spans many
  partitions; values are computed inside each partition and the carries between
  neighbouring partitions come from a table with at most two rows per
  partition, which is therefore safe to broadcast.

An order without a key always takes the second route, so no task ever sees all
rows.  Both routes give the same values; tests run the second with a tiny limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import durable

LIMIT_CONF = "trajgraph.window.maxGroupRows"
DEFAULT_LIMIT = 2_000_000


@dataclass(frozen=True)
class Spec:
    """One output column: ``kind`` is lead, lag, row_number, running_sum or running_max."""

    name: str
    kind: str
    source: Column | str | None = None


def lead(name: str, source: Column | str) -> Spec:
    return Spec(name, "lead", source)


def lag(name: str, source: Column | str) -> Spec:
    return Spec(name, "lag", source)


def row_number(name: str) -> Spec:
    return Spec(name, "row_number")


def running_sum(name: str, source: Column | str) -> Spec:
    return Spec(name, "running_sum", source)


def running_max(name: str, source: Column | str) -> Spec:
    return Spec(name, "running_max", source)


def _col(source: Column | str) -> Column:
    return F.col(source) if isinstance(source, str) else source


def group_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(LIMIT_CONF, str(DEFAULT_LIMIT)))


def is_hot(df: DataFrame, keys: Sequence[str]) -> bool:
    """:func:`has_hot_group` at the session's limit, for callers that order twice."""
    return has_hot_group(df, keys, group_limit(df))


def has_hot_group(df: DataFrame, keys: Sequence[str], limit: int) -> bool:
    """True when some key owns more than ``limit`` rows (one partial aggregate)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return not counts.filter(F.col("n") > limit).isEmpty()


def ordered_columns(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    specs: Sequence[Spec],
    limit: int | None = None,
    hot: bool | None = None,
) -> DataFrame:
    """Add the columns of ``specs``; ``order`` must be total within a key.

    ``hot`` skips the count when the caller already knows the answer, as an
    iteration does whose groups only shrink.
    """
    keys = list(keys)
    order = [_col(o) for o in order]
    if not keys:
        hot = True
    elif hot is None:
        hot = has_hot_group(df, keys, group_limit(df) if limit is None else limit)
    return (_split if hot else _plain)(df, keys, order, specs)


def _plain(df, keys, order, specs):
    window = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(*order)
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {}
    for s in specs:
        if s.kind == "lead":
            out[s.name] = F.lead(_col(s.source)).over(window)
        elif s.kind == "lag":
            out[s.name] = F.lag(_col(s.source)).over(window)
        elif s.kind == "row_number":
            out[s.name] = F.row_number().over(window).cast("long")
        elif s.kind == "running_sum":
            out[s.name] = F.sum(_col(s.source)).over(running)
        elif s.kind == "running_max":
            out[s.name] = F.max(_col(s.source)).over(running)
        else:
            raise ValueError(f"unknown ordered column kind {s.kind}")
    return df.withColumns(out)


def _split(df, keys, order, specs):
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The layout is checkpointed: both the rows and the carries below must see
    # the same partition boundaries even if a task is recomputed.
    ranged = durable(
        df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
        .withColumn("_part", F.spark_partition_id())
    )
    window = Window.partitionBy("_part", *keys).orderBy(*order)
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    local = {"_rn": F.row_number().over(window).cast("long"), "_n": F.count(F.lit(1)).over(whole)}
    carries = {}
    for i, s in enumerate(specs):
        if s.kind == "row_number":
            continue
        boxed = F.struct(_col(s.source).alias("v"))
        if s.kind == "lead":
            local[f"_l{i}"] = F.lead(boxed).over(window)
            carries[f"_e{i}"] = F.first(boxed).over(whole)
        elif s.kind == "lag":
            local[f"_l{i}"] = F.lag(boxed).over(window)
            carries[f"_e{i}"] = F.last(boxed).over(whole)
        elif s.kind == "running_sum":
            local[f"_l{i}"] = F.sum(_col(s.source)).over(running)
            carries[f"_e{i}"] = F.sum(_col(s.source)).over(whole)
        elif s.kind == "running_max":
            local[f"_l{i}"] = F.max(_col(s.source)).over(running)
            carries[f"_e{i}"] = F.max(_col(s.source)).over(whole)
        else:
            raise ValueError(f"unknown ordered column kind {s.kind}")
    rows = ranged.withColumns({**local, **carries})

    # One row per (partition, key); only keys that cross a partition boundary
    # need a carry, and a partition has at most two of those.
    edges = rows.filter(F.col("_rn") == 1).select("_part", *keys, "_n", *carries)
    spans = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_spans")).filter(F.col("_spans") > 1)
    same_key = reduce(
        lambda a, b: a & b, [edges[k].eqNullSafe(spans[k]) for k in keys], F.lit(True)
    )
    edges = edges.join(spans, same_key, "left_semi")
    across = Window.partitionBy(*keys).orderBy("_part")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    shifted = {"_before": F.sum("_n").over(before)}
    for i, s in enumerate(specs):
        if s.kind == "lead":
            shifted[f"_c{i}"] = F.lead(f"_e{i}").over(across)
        elif s.kind == "lag":
            shifted[f"_c{i}"] = F.lag(f"_e{i}").over(across)
        elif s.kind == "running_sum":
            shifted[f"_c{i}"] = F.sum(f"_e{i}").over(before)
        elif s.kind == "running_max":
            shifted[f"_c{i}"] = F.max(f"_e{i}").over(before)
    carry = edges.select(
        F.col("_part").alias("_cpart"),
        *[F.col(k).alias(f"_ck_{k}") for k in keys],
        *[v.alias(n) for n, v in shifted.items()],
    )
    on = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_ck_{k}")) for k in keys],
        F.col("_part") == F.col("_cpart"),
    )
    joined = rows.join(F.broadcast(carry), on, "left")
    out = []
    for i, s in enumerate(specs):
        if s.kind == "row_number":
            value = F.col("_rn") + F.coalesce(F.col("_before"), F.lit(0))
        elif s.kind in ("lead", "lag"):
            edge_row = F.col("_rn") == (F.col("_n") if s.kind == "lead" else F.lit(1))
            value = F.when(edge_row, F.col(f"_c{i}.v")).otherwise(F.col(f"_l{i}.v"))
        elif s.kind == "running_sum":
            value = F.when(F.col(f"_c{i}").isNull(), F.col(f"_l{i}")).otherwise(
                F.coalesce(F.col(f"_l{i}"), F.col(f"_c{i}") * 0) + F.col(f"_c{i}")
            )
        else:
            value = F.greatest(F.col(f"_l{i}"), F.col(f"_c{i}"))
        out.append(value.alias(s.name))
    return joined.select(*[F.col(c) for c in df.columns], *out)

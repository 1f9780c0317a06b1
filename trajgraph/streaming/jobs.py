"""Structured Streaming forms of the append-only and incremental jobs.

The functions take and return streaming frames; starting, checkpointing and
triggers belong to the caller.  :func:`run_available` serves tests and the
registered queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rollups import parse_progress, progress_counters
from ..plans.checkpoints import path_exists, scratch


def progress_counts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Suite counters per key over a stream of log lines (update or complete mode)."""
    parsed = parse_progress(lines)
    return parsed.groupBy(*keys).agg(
        *[F.sum(v).alias(k) for k, v in progress_counters().items()],
        F.max(F.coalesce(F.col("score") == 1.0, F.lit(False))).alias("successful"),
    )


def token_windows(log: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Token sums per package and tumbling window; later rows than ``late`` are dropped."""
    return (
        log.withWatermark("ts", late)
        .groupBy("package", F.window("ts", width))
        .agg(
            F.sum("prompt_tokens").alias("prompt_tokens"),
            F.sum("completion_tokens").alias("completion_tokens"),
            F.count(F.lit(1)).alias("n"),
        )
        .select("package", F.col("window.start").alias("start"), "prompt_tokens", "completion_tokens", "n")
    )


def recent_messages(messages: DataFrame, checks: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Messages sent to the checked number at most ``minutes`` before the check.

    ``messages(message_id, number, sent)``, ``checks(check_id, number, checked)``.  Watermarks and the
    time range bound the state of both sides.
    """
    m = messages.select("message_id", F.col("number").alias("m_number"), "sent").withWatermark("sent", late)
    c = checks.withWatermark("checked", late)
    on = (
        (F.col("m_number") == F.col("number"))
        & (F.col("sent") <= F.col("checked"))
        & (F.col("sent") >= F.col("checked") - F.expr(f"INTERVAL {minutes} MINUTES"))
    )
    return m.join(c, on).select("check_id", "message_id", "number")


def first_episodes(episodes: DataFrame, key: str = "instance_name", late: str = "60 days") -> DataFrame:
    """First finished episode of every instance; repeats inside the watermark are dropped.

    ``episodes(key, finish_dtime, failed)``.  Only an episode that completed and did not
    fail lets its instance be skipped, so a failed run never blocks its own re-run.
    """
    done = episodes.filter(~F.coalesce(F.col("failed"), F.lit(False)))
    return done.withWatermark("finish_dtime", late).dropDuplicatesWithinWatermark([key])


# Buckets of a folded table; a batch reads only those that its keys fall in.
FOLD_BUCKETS = 64


def fold_tables(path: str, shapes: dict[str, tuple[list[str], Callable[[DataFrame], DataFrame]]]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body that adds unseen rows to several tables below ``path``.

    ``shapes`` gives each table's key and how its rows follow from a batch.  Tables are
    bucketed by a hash of the key.  A batch that is replayed adds nothing, since its keys
    are stored by then.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        for name, (key, rows) in shapes.items():
            new = rows(batch).dropDuplicates(key).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(FOLD_BUCKETS)).cast("int"))
            target = f"{path}/{name}"
            if path_exists(spark, target):
                touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
                stored = spark.read.parquet(target).filter(F.col("bucket").isin(touched))
                new = new.join(stored.select(*key), key, "left_anti")
            new.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(target)
        batch.unpersist()

    return upsert


def graph_shapes() -> dict[str, tuple[list[str], Callable[[DataFrame], DataFrame]]]:
    """Tables of the graph memory from ``(task, step, src, elem, tgt, goal)`` rows: edges, pages, steps and goals of both ends."""

    def ends(batch, *more, after=()):
        src = batch.select(F.col("src").alias("page_id"), *more)
        return src.unionByName(batch.select(F.col("tgt").alias("page_id"), *(after or more)))

    step, following = F.col("step"), (F.col("step") + 1).alias("step")
    return {
        "edges": (["src", "elem", "tgt"], lambda b: b.select("src", "elem", "tgt")),
        "pages": (["page_id"], lambda b: ends(b)),
        "page_steps": (["page_id", "task", "step"], lambda b: ends(b, "task", step, after=("task", following))),
        "page_goals": (["page_id", "goal"], lambda b: ends(b, "goal")),
    }


WALK = "task string, branch string, step long, src string, tgt string, late boolean"
WALK_STATE = "branch array<string>, page array<string>, seen_us array<long>, step array<long>, until_ms array<long>"


def walk_sessions(steps: DataFrame, late: str = "1 hour") -> DataFrame:
    """Transitions of every trajectory, carrying its page and step between batches.

    ``steps(task, branch, ts, page)``.  Steps older than the last one seen of their
    trajectory cannot be placed any more and come out flagged ``late``.  The state of
    a trajectory is one page, and it expires ``late`` after the last step seen.
    Trajectories are many and short, so those of a task share one group; a call for each of
    them would cost far more than its steps.
    """
    late_ms = int(pd.Timedelta(late).total_seconds() * 1000)

    def text(column):
        return [v if isinstance(v, str) else None for v in column.tolist()]

    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        held = {b: tuple(more) for b, *more in zip(*state.get)} if state.exists else {}
        rows = []
        if not state.hasTimedOut:
            for pdf in batches:
                rows += zip(text(pdf["branch"]), pdf["ts"].to_numpy("datetime64[us]").astype("int64").tolist(), text(pdf["page"]))
        rows.sort(key=lambda r: (r[1], r[2] is None, r[2] or ""))
        # Trajectories that expired go, unless steps of theirs are here.
        here = {r[0] for r in rows}
        held = {b: h for b, h in held.items() if b in here or h[3] >= mark}
        out = []
        for branch, at, name in rows:
            page, seen, step, until = held.get(branch, (None, -1, -1, 0))
            if at < seen:
                out.append((branch, None, None, name, True))
            else:
                if page is not None:
                    out.append((branch, step, page, name, False))
                page, seen, step = name, at, step + 1
            held[branch] = page, seen, step, max(seen // 1000, mark) + late_ms
        if held:
            state.update((list(held), *map(list, zip(*held.values()))))
            state.setTimeoutTimestamp(min(h[3] for h in held.values()))
        elif state.exists:
            state.remove()
        if out:
            branches, numbers, sources, targets, flags = zip(*out)
            yield pd.DataFrame(
                {"task": key[0], "branch": branches, "step": pd.array(numbers, "Int64"), "src": sources, "tgt": targets, "late": flags}
            )

    return (
        steps.withWatermark("ts", late)
        .groupBy("task")
        .applyInPandasWithState(advance, WALK, WALK_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def run_available(stream: DataFrame, name: str, mode: str = "append", body: Callable | None = None) -> DataFrame:
    """Run a stream over the input that is there and read its result back.

    Append mode writes parquet; other modes keep the last result per batch.
    """
    spark = stream.sparkSession
    folder = scratch(spark, name)
    out = f"{folder}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if body is not None:
        writer = writer.foreachBatch(body)
    elif mode == "append":
        writer = writer.format("parquet").option("path", out).outputMode("append")
    else:
        writer = writer.outputMode(mode).foreachBatch(
            lambda batch, _: batch.write.mode("overwrite").parquet(out)
        )
    writer.start().awaitTermination()
    return spark.read.parquet(out) if body is None else None

"""Streaming queries: each reads the events table as a file stream to its end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import adapters as A
from ..plans.adapters import with_ctes
from ..plans.checkpoints import scratch
from ..streaming import jobs as X
from .registry import query
from .rollups import PROGRESS, TOKEN_LOG, as_progress_lines, as_token_log


@query(
    "X01_progress_stream",
    with_ctes(
        "ev",
        """SELECT task, count(*) FILTER (kind IN ('DONE', 'ERROR')) AS completed, count(*) FILTER (kind = 'DONE' AND score >= 1.0) AS succeeded,
                  count(*) FILTER (kind = 'ERROR') AS errored, count(*) FILTER (kind = 'SKIP') AS skipped,
                  coalesce(bool_or(score = 1.0), FALSE) AS successful FROM log GROUP BY task""",
        extra=PROGRESS,
    ),
)
def _(spark, sf):
    counts = X.progress_counts(as_progress_lines(A.event_stream(spark, sf)), ["task"])
    return X.run_available(counts, "progress", mode="complete")


@query(
    "X02_token_stream",
    with_ctes(
        "ev",
        """SELECT package, CAST(floor(epoch(date_trunc('hour', ts))) AS BIGINT) AS start_s, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
                  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, count(*) AS n FROM log GROUP BY ALL""",
        extra=TOKEN_LOG,
    ),
)
def _(spark, sf):
    windows = X.token_windows(as_token_log(A.event_stream(spark, sf)))
    out = X.run_available(windows, "tokens", mode="complete")
    return out.select("package", F.unix_seconds("start").alias("start_s"), "prompt_tokens", "completion_tokens", "n")


@query(
    "X03_recent_message",
    with_ctes(
        "ev",
        """SELECT c.event_id AS check_id, m.event_id AS message_id, m.user_id AS number FROM ev m JOIN ev c ON c.user_id = m.user_id
           WHERE m.event_type = 'view' AND c.event_type = 'error' AND m.ts <= c.ts AND m.ts >= c.ts - INTERVAL 600 MINUTE""",
    ),
)
def _(spark, sf):
    m = A.event_stream(spark, sf).filter("event_type = 'view'").select(
        F.col("event_id").alias("message_id"), F.col("user_id").alias("number"), F.col("ts").alias("sent")
    )
    c = A.event_stream(spark, sf).filter("event_type = 'error'").select(
        F.col("event_id").alias("check_id"), F.col("user_id").alias("number"), F.col("ts").alias("checked")
    )
    return X.run_available(X.recent_messages(m, c, minutes=600), "messages")


@query(
    "X04_graph_fold_stream",
    with_ctes(
        "ev",
        """SELECT DISTINCT 'edge' AS kind, src || ' ' || elem || ' ' || tgt AS value FROM moves
           UNION SELECT 'page', page_id FROM both_ends UNION SELECT 'step', page_id || ' ' || task || ' ' || step FROM both_ends
           UNION SELECT 'goal', page_id || ' ' || goal FROM both_ends""",
        extra="""
moves AS (
  SELECT event_type || '_' || k AS src, 'tap' || (k // 25) AS elem, event_type || '_' || ((k * 7) % 100) AS tgt,
         'u' || user_id AS task, event_id % 9 AS step, 'goal' || (k % 5) AS goal FROM ev),
both_ends AS (SELECT src AS page_id, task, step, goal FROM moves UNION SELECT tgt, task, step + 1, goal FROM moves)""",
    ),
)
def _(spark, sf):
    k = F.col("k")
    moves = A.event_stream(spark, sf).select(
        F.concat_ws("_", "event_type", k.cast("string")).alias("src"), F.concat(F.lit("tap"), F.floor(k / 25).cast("string")).alias("elem"),
        F.concat_ws("_", "event_type", (k * 7 % 100).cast("string")).alias("tgt"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("task"),
        (F.col("event_id") % 9).alias("step"), F.concat(F.lit("goal"), (k % 5).cast("string")).alias("goal"),
    )
    folder = scratch(spark, "graph")
    X.run_available(moves, "fold", body=X.fold_tables(folder, X.graph_shapes()))
    kinds = {"edge": ("edges", ["src", "elem", "tgt"]), "page": ("pages", ["page_id"]),
             "step": ("page_steps", ["page_id", "task", "step"]), "goal": ("page_goals", ["page_id", "goal"])}
    parts = [
        spark.read.parquet(f"{folder}/{name}").select(F.lit(kind).alias("kind"), F.concat_ws(" ", *[F.col(c).cast("string") for c in key]).alias("value"))
        for kind, (name, key) in kinds.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "X05_episode_resume",
    with_ctes("episodes", "SELECT DISTINCT instance_name FROM episodes WHERE exception_info IS NULL"),
)
def _(spark, sf):
    k = F.col("k")
    name = F.concat_ws("_", F.when(k != 99, F.concat(F.lit("Task"), F.floor(k / 4).cast("string"))), F.col("user_id").cast("string"))
    episodes = A.event_stream(spark, sf).select(name.alias("instance_name"), F.col("ts").alias("finish_dtime"), (F.col("event_type") == "error").alias("failed"))
    return X.run_available(X.first_episodes(episodes), "resume").select("instance_name")


@query(
    "X06_trajectory_sessions",
    with_ctes("edges", "SELECT task, branch, step, src, tgt, FALSE AS late FROM edges"),
)
def _(spark, sf):
    steps = A.event_stream(spark, sf).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("task"), F.date_format("ts", "yyyy-MM-dd").alias("branch"),
        "ts", F.concat_ws("_", "event_type", F.col("k").cast("string")).alias("page"),
    )
    return X.run_available(X.walk_sessions(steps), "walk")

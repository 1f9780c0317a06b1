"""Episode report, token, progress and answer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gold as GP
from ..operators import rollups as R
from ..plans import adapters as A
from ..plans.adapters import with_ctes
from ..plans.checkpoints import scratch
from .registry import query

ROLLUP = """
report AS (
  SELECT task_template, count(is_successful) AS num_complete_trials, avg(is_successful) AS mean_success_rate,
         avg(episode_length) AS mean_episode_length, CAST(round(sum(run_time), 1) AS DOUBLE) AS total_runtime_s,
         count(exception_info) AS num_fail_trials
  FROM episodes WHERE task_template IS NOT NULL GROUP BY task_template),
tagged AS (SELECT r.*, m.difficulty, m.optimal_steps, m.tags FROM report r LEFT JOIN task_metadata m USING (task_template)),
exploded AS (SELECT CASE WHEN tag = '' THEN 'untagged' ELSE tag END AS tag, difficulty, mean_success_rate
             FROM (SELECT unnest(tags) AS tag, difficulty, mean_success_rate FROM tagged))"""


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(
    "E01_episode_rollup",
    with_ctes(
        "episodes task_metadata",
        """SELECT task_template, num_complete_trials, round(mean_success_rate, 6) AS mean_success_rate,
                  round(mean_episode_length, 6) AS mean_episode_length, total_runtime_s, num_fail_trials FROM report""",
        extra=ROLLUP,
    ),
)
def _(spark, sf):
    return rounded(R.episode_rollup(A.episodes(spark, sf)), "mean_success_rate", "mean_episode_length")


@query(
    "E02_grand_average_row",
    with_ctes(
        "episodes task_metadata",
        """SELECT row_number() OVER (ORDER BY task_template) - 1 AS task_num, task_template AS task,
                  CAST(num_complete_trials AS DOUBLE) AS num_complete_trials, round(mean_success_rate, 6) AS mean_success_rate,
                  round(mean_episode_length, 6) AS mean_episode_length, total_runtime_s,
                  CAST(num_fail_trials AS DOUBLE) AS num_fail_trials FROM report
           UNION ALL
           SELECT 0, '========= Average =========', avg(num_complete_trials), round(avg(mean_success_rate), 6),
                  round(avg(mean_episode_length), 6), avg(total_runtime_s), avg(num_fail_trials) FROM report""",
        extra=ROLLUP,
    ),
)
def _(spark, sf):
    out = R.with_average_row(R.episode_rollup(A.episodes(spark, sf)))
    return rounded(out, "mean_success_rate", "mean_episode_length")


@query(
    "J08_metadata_join",
    with_ctes(
        "episodes task_metadata",
        "SELECT task_template, num_complete_trials, difficulty, optimal_steps FROM tagged",
        extra=ROLLUP,
    ),
)
def _(spark, sf):
    out = R.metadata_join(R.episode_rollup(A.episodes(spark, sf)), A.task_metadata(spark, sf))
    return out.select("task_template", "num_complete_trials", "difficulty", "optimal_steps")


def _tagged(spark, sf):
    return R.metadata_join(R.episode_rollup(A.episodes(spark, sf)), A.task_metadata(spark, sf))


@query(
    "E03_tag_pivot",
    with_ctes(
        "episodes task_metadata",
        "SELECT tag, "
        + ", ".join(
            f"coalesce(printf('%.6f', round(avg(mean_success_rate) FILTER (difficulty = '{d}'), 6)), '-') AS {d}"
            for d in ("easy", "medium", "hard")
        )
        + " FROM exploded GROUP BY tag",
        extra=ROLLUP,
    ),
)
def _(spark, sf):
    return R.tag_pivot(_tagged(spark, sf))


@query(
    "E03_tag_counts",
    with_ctes(
        "episodes task_metadata",
        "SELECT tag, difficulty, count(*) AS num_tasks FROM exploded GROUP BY ALL",
        extra=ROLLUP,
    ),
)
def _(spark, sf):
    return R.tag_counts(_tagged(spark, sf))


TOKEN_LOG = """
log AS (
  SELECT event_id, ts, event_type AS package, 'u' || user_id AS task, 'stage' || (k // 25) AS stage, k AS prompt_tokens,
         CAST(floor(value) AS BIGINT) AS completion_tokens, CAST(value AS DECIMAL(18,2)) AS duration_seconds FROM ev)"""


def token_log(spark, sf):
    return as_token_log(A._events(spark, sf))


def as_token_log(ev):
    return ev.select(
        "event_id", "ts", F.col("event_type").alias("package"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("task"),
        F.concat(F.lit("stage"), F.floor(F.col("k") / 25).cast("string")).alias("stage"),
        F.col("k").cast("long").alias("prompt_tokens"),
        F.floor("value").alias("completion_tokens"),
        F.col("value").cast("decimal(18,2)").alias("duration_seconds"),
    )


@query(
    "E04_token_running_totals",
    with_ctes(
        "ev",
        """SELECT event_id, package, CAST(sum(prompt_tokens) OVER w AS BIGINT) AS total_prompt,
                  CAST(sum(completion_tokens) OVER w AS BIGINT) AS total_completion,
                  CAST(sum(duration_seconds) OVER w AS DOUBLE) AS total_seconds
           FROM log WINDOW w AS (PARTITION BY package ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
        extra=TOKEN_LOG,
    ),
)
def _(spark, sf):
    return R.token_running_totals(token_log(spark, sf)).select(
        "event_id", "package", "total_prompt", "total_completion", F.col("total_seconds").cast("double").alias("total_seconds")
    )


@query(
    "E04_token_totals",
    with_ctes(
        "ev",
        """SELECT package, task, stage, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
                  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
                  CAST(sum(duration_seconds) AS DOUBLE) AS duration_seconds
           FROM log GROUP BY ROLLUP (package, task, stage)""",
        extra=TOKEN_LOG,
    ),
)
def _(spark, sf):
    return R.token_totals(token_log(spark, sf)).withColumn("duration_seconds", F.col("duration_seconds").cast("double"))


@query(
    "S16_token_log_sink",
    with_ctes("ev", "SELECT event_id, package, task, stage, prompt_tokens, completion_tokens FROM log", extra=TOKEN_LOG),
)
def _(spark, sf):
    from ..sources.logs import append_token_log, read_token_log

    rows = token_log(spark, sf)
    folder = scratch(spark, "token-log")
    for part in (0, 1):  # two appends, read back together
        append_token_log(rows.filter(F.col("event_id") % 2 == part).drop("ts"), folder)
    schema = "event_id long, package string, task string, stage string, prompt_tokens long, completion_tokens long"
    return read_token_log(spark, folder, schema)


PROGRESS = """
log AS (
  SELECT event_id, user_id, ts, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'SKIP' ELSE 'DONE' END AS kind,
         'Task' || (k // 4) AS task, k AS instance,
         CASE WHEN event_type NOT IN ('error', 'signup') THEN CASE WHEN value >= 50 THEN 1.0 ELSE 0.5 END END AS score FROM ev),
running AS (
  SELECT event_id, user_id, count(*) FILTER (kind IN ('DONE', 'ERROR')) OVER w AS completed,
         count(*) FILTER (kind = 'DONE' AND score >= 1.0) OVER w AS succeeded,
         count(*) FILTER (kind = 'ERROR') OVER w AS errored, count(*) FILTER (kind = 'SKIP') OVER w AS skipped
  FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""


def progress_lines(spark, sf):
    return as_progress_lines(A._events(spark, sf))


def as_progress_lines(ev):
    kind = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "SKIP ").otherwise("DONE ")
    tail = F.when(kind == "ERROR", " | error=boom").when(kind == "SKIP ", " | reason: none").otherwise(
        F.concat(F.lit(" | score="), F.when(F.col("value") >= 50, "1.0").otherwise("0.5"))
    )
    line = F.concat(
        F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("] "), kind, F.lit(" Task"),
        F.floor(F.col("k") / 4).cast("string"), F.lit("_"), F.col("k").cast("string"), tail, F.lit(" | done"),
    )
    return ev.select("event_id", "user_id", "ts", line.alias("value"))


@query(
    "S03_progress_log_scan",
    with_ctes(
        "ev",
        "SELECT task, bool_or(score = 1.0) AS successful FROM log WHERE kind = 'DONE' GROUP BY task",
        extra=PROGRESS,
    ),
)
def _(spark, sf):
    return R.successful_tasks(R.parse_progress(progress_lines(spark, sf)))


@query(
    "S05_gold_snapshot",
    with_ctes(
        "ev",
        """SELECT p.package, count(*) AS all_task_count, count(*) FILTER (s.ok) AS gold_task_count
           FROM (SELECT DISTINCT event_type AS package, 'Task' || (k // 4) || '@' || user_id AS task FROM ev) p
           LEFT JOIN (SELECT task || '@' || user_id AS task, bool_or(score = 1.0) AS ok FROM log
                      WHERE kind = 'DONE' GROUP BY 1) s ON s.task = p.task GROUP BY p.package""",
        extra=PROGRESS,
    ),
)
def _(spark, sf):
    scoped = F.concat_ws("@", "task", F.col("user_id").cast("string"))
    parsed = R.parse_progress(progress_lines(spark, sf)).withColumn("task", scoped)
    good = R.successful_tasks(parsed).filter("successful")
    tasks = A._events(spark, sf).select(
        F.col("event_type").alias("package"),
        F.concat(F.lit("Task"), F.floor(F.col("k") / 4).cast("string"), F.lit("@"), F.col("user_id").cast("string")).alias("task"),
    )
    return GP.gold_snapshot(tasks, good)


@query(
    "E05_suite_progress",
    with_ctes(
        "ev",
        """SELECT *, round(CASE WHEN completed > 0 THEN succeeded / completed * 100 ELSE 0 END, 6) AS rate FROM running""",
        extra=PROGRESS,
    ),
)
def _(spark, sf):
    out = R.suite_progress(R.parse_progress(progress_lines(spark, sf)), ["user_id"], ["ts", "event_id"])
    return out.select("event_id", "user_id", "completed", "succeeded", "errored", "skipped", F.round("rate", 6).alias("rate"))


@query(
    "E05_suite_summary",
    with_ctes(
        "ev",
        """SELECT user_id, count(*) FILTER (kind IN ('DONE', 'ERROR')) AS completed,
                  count(*) FILTER (kind = 'DONE' AND score >= 1.0) AS succeeded,
                  count(*) FILTER (kind = 'ERROR') AS errored, count(*) FILTER (kind = 'SKIP') AS skipped
           FROM log GROUP BY user_id""",
        extra=PROGRESS,
    ),
)
def _(spark, sf):
    return R.suite_summary(R.parse_progress(progress_lines(spark, sf)), ["user_id"])


@query(
    "E09_resume_sets",
    with_ctes(
        "episodes",
        """SELECT instance_name, bool_or(exception_info IS NULL) AS completed, bool_or(exception_info IS NOT NULL) AS failed,
                  bool_or(exception_info IS NULL) AND NOT bool_or(exception_info IS NOT NULL) AS done
           FROM episodes GROUP BY instance_name""",
    ),
)
def _(spark, sf):
    return R.resume_sets(A.episodes(spark, sf))


@query(
    "E09_resume_remaining",
    with_ctes(
        "episodes",
        """SELECT DISTINCT instance_name FROM episodes WHERE instance_name NOT IN (
             SELECT instance_name FROM episodes GROUP BY 1
             HAVING bool_or(exception_info IS NULL) AND NOT bool_or(exception_info IS NOT NULL))""",
    ),
)
def _(spark, sf):
    e = A.episodes(spark, sf)
    return R.resume_remaining(e.select("instance_name").distinct(), e)


@query(
    "E10_correct_total",
    with_ctes(
        "episodes",
        """SELECT instance_id, count(*) FILTER (is_successful > 0.5) OVER w AS correct, count(*) OVER w AS total
           FROM episodes WHERE exception_info IS NULL
           WINDOW w AS (PARTITION BY seed ORDER BY finish_dtime, instance_id ROWS UNBOUNDED PRECEDING)""",
    ),
)
def _(spark, sf):
    out = R.running_correct(A.episodes(spark, sf), ["seed"], ["finish_dtime", "instance_id"])
    return out.select("instance_id", "correct", "total")


@query(
    "F16_fail_only",
    with_ctes("episodes", "SELECT instance_id FROM episodes WHERE is_successful IS DISTINCT FROM 1.0"),
)
def _(spark, sf):
    return R.unsuccessful(A.episodes(spark, sf)).select("instance_id")


@query(
    "E11_transpose",
    """SELECT l_orderkey, len(p) AS n, p[1] AS first_part, p[-1] AS last_part, list_sum(q) AS quantity FROM (
         SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS p,
                list(l_quantity ORDER BY l_linenumber) AS q FROM lineitem GROUP BY l_orderkey)""",
)
def _(spark, sf):
    li = A.table(spark, sf, "lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey"))
    cols = R.to_columns(li, "l_orderkey", "at", ["l_partkey", "l_quantity"])
    total = F.aggregate("l_quantity", F.lit(0.0), lambda s, x: s + x)
    return cols.select(
        "l_orderkey", F.size("l_partkey").cast("long").alias("n"), F.col("l_partkey")[0].alias("first_part"),
        F.element_at("l_partkey", -1).alias("last_part"), total.alias("quantity"),
    )


@query(
    "E11_transpose_parts",
    """SELECT l_orderkey, part, array_to_string(list(l_partkey ORDER BY rn), ',') AS parts FROM (
         SELECT *, (rn - 1) // 3 AS part FROM (
           SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem))
       GROUP BY l_orderkey, part""",
)
def _(spark, sf):
    li = A.table(spark, sf, "lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey"))
    parts = R.to_columns(li, "l_orderkey", "at", ["l_partkey"], part_rows=3)
    return parts.select("l_orderkey", F.col("part").cast("long").alias("part"), F.array_join("l_partkey", ",").alias("parts"))


@query(
    "E11_transpose_back",
    """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos,
              l_partkey FROM lineitem""",
)
def _(spark, sf):
    li = A.table(spark, sf, "lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey"))
    cols = R.to_columns(li, "l_orderkey", "at", ["l_partkey", "l_quantity"])
    return R.to_records(cols, "l_orderkey", ["l_partkey", "l_quantity"]).select(
        "l_orderkey", F.col("pos").cast("long").alias("pos"), "l_partkey"
    )


@query(
    "E13_step_budget",
    "SELECT p_partkey, CAST(floor(10 * (p_size / 4)) AS BIGINT) AS budget FROM part",
)
def _(spark, sf):
    return A.table(spark, sf, "part").select("p_partkey", R.step_budget(F.col("p_size") / 4).alias("budget"))


@query(
    "E07_playlist_total_between",
    """SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS total, sum(l_quantity) BETWEEN 45 AND 150 AS ok
       FROM lineitem GROUP BY l_orderkey""",
)
def _(spark, sf):
    return R.metric_between(A.table(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity", 45, 150)


def states(spark, sf):
    """Nested records: each order as a state with calendar events and a task list."""
    o = A.table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "MMMM d yyyy")
    event = F.struct(
        day.alias("start_date"), F.floor(F.col("o_totalprice") / 1000).cast("string").alias("duration"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("title"),
    )
    second = F.struct(
        day.alias("start_date"), F.lit("30").alias("duration"), F.lit(None).cast("string").alias("title")
    )
    note = F.struct(F.col("o_orderpriority").alias("folder"), F.col("o_orderstatus").alias("title"))
    return o.select(
        "o_custkey",
        F.struct(
            F.struct(F.array(event, second).alias("events")).alias("calendar"), F.array(note).alias("notes_app")
        ).alias("state"),
    )


@query(
    "E08_ir_sum",
    "SELECT o_custkey, CAST(sum(floor(o_totalprice / 1000) + 30) AS DOUBLE) AS answer FROM orders GROUP BY o_custkey",
)
def _(spark, sf):
    return R.answer_sum(R.field_values(states(spark, sf), "o_custkey", "state", "duration"), "o_custkey")


@query(
    "E08_ir_count",
    """SELECT o_custkey, count(*) + count(*) FILTER (o_orderstatus <> 'P') AS answer FROM orders GROUP BY o_custkey""",
)
def _(spark, sf):
    return R.answer_count(R.field_values(states(spark, sf), "o_custkey", "state", "title"), "o_custkey")


@query(
    "E08_ir_identity",
    """SELECT o_custkey, value, count(*) AS n FROM (
         SELECT o_custkey, strftime(o_orderdate, '%B %-d %Y') AS value FROM orders
         UNION ALL SELECT o_custkey, strftime(o_orderdate, '%B %-d %Y') FROM orders) GROUP BY ALL""",
)
def _(spark, sf):
    v = R.field_values(states(spark, sf), "o_custkey", "state", "start_date")
    return v.groupBy("o_custkey", "value").agg(F.count(F.lit(1)).alias("n"))

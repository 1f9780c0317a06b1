"""Episode reports, token and progress totals, answers over nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ordered import ordered_columns, row_number, running_sum

REPORT = ("num_complete_trials", "mean_success_rate", "mean_episode_length", "total_runtime_s", "num_fail_trials")


def episode_rollup(episodes: DataFrame) -> DataFrame:
    """One row per task template; episodes without one are left out."""
    return (
        episodes.filter(F.col("task_template").isNotNull())
        .groupBy("task_template")
        .agg(
            F.count("is_successful").alias("num_complete_trials"),
            F.avg("is_successful").alias("mean_success_rate"),
            F.avg("episode_length").alias("mean_episode_length"),
            F.round(F.sum("run_time"), 1).cast("double").alias("total_runtime_s"),
            F.count("exception_info").alias("num_fail_trials"),
        )
    )


def with_average_row(report: DataFrame) -> DataFrame:
    """Numbered report rows plus their average row.

    The average is over the rows of the report, skipping missing values per column,
    so it is a mean of group means; its number is 0.
    """
    rows = ordered_columns(
        report.withColumnRenamed("task_template", "task"), [], ["task"], [row_number("n")]
    ).select(
        (F.col("n") - 1).alias("task_num"), "task", *[F.col(c).cast("double").alias(c) for c in REPORT]
    )
    # Fixed value: the label of the average row.
    mean = report.agg(*[F.avg(c).alias(c) for c in REPORT]).select(
        F.lit(0).cast("long").alias("task_num"), F.lit("========= Average =========").alias("task"), *REPORT
    )
    return rows.unionByName(mean)


def metadata_join(report: DataFrame, metadata: DataFrame) -> DataFrame:
    return report.join(metadata, "task_template", "left")


def tag_pivot(tagged: DataFrame, levels: tuple[str, ...] = ("easy", "medium", "hard")) -> DataFrame:
    """Mean of mean success by (tag, difficulty), difficulties as columns, gaps as ``-``."""
    rows = tagged.select(
        F.explode("tags").alias("tag"), "difficulty", "mean_success_rate"
    ).withColumn("tag", F.when(F.col("tag") == "", "untagged").otherwise(F.col("tag")))
    wide = rows.groupBy("tag").pivot("difficulty", list(levels)).agg(F.avg("mean_success_rate"))
    return wide.select(
        "tag", *[F.coalesce(F.format_string("%.6f", F.round(c, 6)), F.lit("-")).alias(c) for c in levels]
    )


def tag_counts(tagged: DataFrame) -> DataFrame:
    rows = tagged.select(F.explode("tags").alias("tag"), "difficulty")
    rows = rows.withColumn("tag", F.when(F.col("tag") == "", "untagged").otherwise(F.col("tag")))
    return rows.groupBy("tag", "difficulty").agg(F.count(F.lit(1)).alias("num_tasks"))


def token_running_totals(log: DataFrame) -> DataFrame:
    """Running token and time totals of each package, in log order."""
    return ordered_columns(
        log,
        ["package"],
        ["ts", "event_id"],
        [
            running_sum("total_prompt", "prompt_tokens"),
            running_sum("total_completion", "completion_tokens"),
            running_sum("total_seconds", "duration_seconds"),
        ],
    )


def token_totals(log: DataFrame) -> DataFrame:
    """Sums per stage with sub-totals per task and package and a grand total."""
    return log.rollup("package", "task", "stage").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("duration_seconds").alias("duration_seconds"),
    )


# The layout of progress log lines.
LOG_TASK = r"(DONE|SKIP|ERROR)\s+(\S+?)_(\d+)\s"
LOG_SCORE = r"DONE\s+\S+?_\d+\s.*?score=([\d.]+)"


def parse_progress(lines: DataFrame, column: str = "value") -> DataFrame:
    """Kind, task, instance and score of progress log lines; other lines go."""
    text = F.col(column)
    return lines.withColumns(
        {
            "kind": F.regexp_extract(text, LOG_TASK, 1),
            "task": F.regexp_extract(text, LOG_TASK, 2),
            "instance": F.regexp_extract(text, LOG_TASK, 3).try_cast("long"),
            "score": F.regexp_extract(text, LOG_SCORE, 1).try_cast("double"),
        }
    ).filter(F.col("kind") != "")


def successful_tasks(parsed: DataFrame) -> DataFrame:
    """Success per task: any instance with score exactly 1."""
    return parsed.filter(F.col("kind") == "DONE").groupBy("task").agg(
        F.max(F.col("score") == 1.0).alias("successful")
    )


def progress_counters() -> dict[str, Column]:
    """0/1 columns behind the suite counters; errors count as completed, skips do not."""
    kind = F.col("kind")
    return {
        "completed": kind.isin("DONE", "ERROR").cast("long"),
        "succeeded": ((kind == "DONE") & (F.col("score") >= 1.0)).cast("long"),
        "errored": (kind == "ERROR").cast("long"),
        "skipped": (kind == "SKIP").cast("long"),
    }


def suite_progress(parsed: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Running counters and success rate after every log line."""
    counters = progress_counters()
    flagged = parsed.withColumns({f"is_{k}": v for k, v in counters.items()})
    out = ordered_columns(flagged, keys, order, [running_sum(k, f"is_{k}") for k in counters])
    rate = F.when(F.col("completed") > 0, F.col("succeeded") / F.col("completed") * 100).otherwise(F.lit(0.0))
    return out.drop(*[f"is_{k}" for k in counters]).withColumn("rate", rate)


def suite_summary(parsed: DataFrame, keys: list[str]) -> DataFrame:
    return parsed.groupBy(*keys).agg(*[F.sum(v).alias(k) for k, v in progress_counters().items()])


def resume_sets(episodes: DataFrame) -> DataFrame:
    """Completed / failed flags per instance; done means completed and not failed."""
    failed = F.col("exception_info").isNotNull()
    flags = episodes.groupBy("instance_name").agg(
        F.max(~failed).alias("completed"), F.max(failed).alias("failed")
    )
    return flags.withColumn("done", F.col("completed") & ~F.col("failed"))


def resume_remaining(instances: DataFrame, episodes: DataFrame) -> DataFrame:
    done = resume_sets(episodes).filter("done")
    return instances.join(done, "instance_name", "left_anti")


def running_correct(episodes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Running correct and total counts, without failed runs."""
    ok = episodes.filter(F.col("exception_info").isNull())
    ok = ok.withColumn("_hit", (F.col("is_successful") > 0.5).cast("long")).withColumn("_one", F.lit(1).cast("long"))
    return ordered_columns(
        ok, keys, order, [running_sum("correct", "_hit"), running_sum("total", "_one")]
    ).drop("_hit", "_one")


def unsuccessful(episodes: DataFrame) -> DataFrame:
    """Episodes to report when only failures are wanted; runs without a verdict stay."""
    return episodes.filter(~(F.col("is_successful").eqNullSafe(1.0)))


def to_columns(records: DataFrame, key: str, order: str, fields: list[str], part_rows: int | None = None) -> DataFrame:
    """List of records per key as one row of column arrays; absent values are dropped,
    so the arrays may be ragged.  Meant for the steps of one episode.

    With ``part_rows`` a key of any length becomes rows ``part`` 0, 1, … of that many records in order, so that no
    task gathers a whole key.
    """
    keys = [key]
    if part_rows:
        records = ordered_columns(records, [key], [order], [row_number("_i")])
        records = records.withColumn("part", F.floor((F.col("_i") - 1) / part_rows).cast("int")).drop("_i")
        keys = [key, "part"]
    arr = F.array_sort(F.collect_list(F.struct(order, *fields)))
    rows = records.groupBy(*keys).agg(arr.alias("_r"))
    return rows.select(*keys, *[F.array_compact(F.col("_r")[f]).alias(f) for f in fields])


def to_records(columns: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Inverse of :func:`to_columns` for arrays of equal length."""
    return columns.select(key, F.posexplode(F.arrays_zip(*fields)).alias("pos", "_r")).select(
        key, "pos", *[F.col(f"_r.{f}").alias(f) for f in fields]
    )


def step_budget(complexity: Column) -> Column:
    """``int(10 × complexity)``; a missing complexity is an error."""
    return F.when(complexity.isNotNull(), F.floor(complexity * 10)).otherwise(
        F.raise_error(F.lit("task complexity is missing"))
    )


def metric_between(rows: DataFrame, keys: list[str], column: str, low: float, high: float) -> DataFrame:
    total = F.sum(column)
    return rows.groupBy(*keys).agg(total.alias("total"), total.between(low, high).alias("ok"))


# ------------------------------------------------------------- nested answers


def field_paths(schema: T.StructType, name: str, prefix: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Every path in a nested schema that ends in a field called ``name``."""
    out = []
    for f in schema.fields:
        path = (*prefix, f.name)
        inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if f.name == name:
            out.append(path)
        elif isinstance(inner, T.StructType):
            out.extend(field_paths(inner, name, path))
    return out


def field_values(states: DataFrame, key: str, root: str, name: str) -> DataFrame:
    """All non-null values of a field at any nesting depth, one row each."""
    parts = []
    top = states.schema[root].dataType
    for path in field_paths(top, name):
        frame, here, kind = states.select(key, F.col(root).alias("_v")), "_v", top
        for step in path:
            kind = kind[step].dataType
            frame = frame.select(key, F.col(f"{here}.{step}").alias("_v"))
            if isinstance(kind, T.ArrayType):
                frame = frame.select(key, F.explode("_v").alias("_v"))
                kind = kind.elementType
        parts.append(frame.select(key, F.col("_v").cast("string").alias("value")))
    if not parts:
        raise ValueError(f"no field {name!r} below {root!r}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("value").isNotNull())


def answer_sum(values: DataFrame, key: str) -> DataFrame:
    return values.groupBy(key).agg(F.sum(F.col("value").cast("double")).alias("answer"))


def answer_count(values: DataFrame, key: str) -> DataFrame:
    return values.groupBy(key).agg(F.count(F.lit(1)).alias("answer"))

"""Gold-path assembly and export shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import first_goal, simplified


def gold_paths(enriched: DataFrame, is_group: Column | None = None) -> DataFrame:
    """One row per path: task, goal and its simplified (source, element, target) arrays.

    ``enriched`` comes from ``paths.enrich_steps`` with ``task, path_id, pos``.
    """
    text = simplified(is_group=is_group)
    step = F.array(text["source_page"], text["element"], text["target_page"])
    rows = enriched.groupBy("task", "path_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", step.alias("s"))))["s"].alias("path")
    )
    return rows.join(first_goal(enriched), "path_id").select("task", "path_id", "goal", "path")


def is_success(value: Column) -> Column:
    """Success flag of a gold entry: null, true, 1 or one of a few words."""
    # Words that count as success.
    words = ["yes", "true", "1", "success", "successful"]
    text = F.lower(F.trim(value.cast("string")))
    number = text.try_cast("double")
    return value.isNull() | text.isin(words) | F.coalesce(number == 1, F.lit(False))


def convert_entries(gold: DataFrame) -> DataFrame:
    """Gold entries to triplet arrays, with their count of action-group steps."""
    groups = F.size(F.filter("path", lambda s: F.element_at(s, 2).contains("_$Action_")))
    return gold.select("*", F.size("path").alias("n_steps"), groups.alias("n_action_groups"))


def gold_snapshot(tasks: DataFrame, successful: DataFrame) -> DataFrame:
    """Per package: number of tasks and of successful ones.

    ``tasks(package, task)``, ``successful(task)``.  The task lists themselves stay rows
    (:func:`gold_tasks`), since a package can hold any number of tasks.
    """
    flagged = gold_tasks(tasks, successful)
    return flagged.groupBy("package").agg(
        F.count(F.lit(1)).alias("all_task_count"), F.sum(F.col("is_gold").cast("long")).alias("gold_task_count")
    )


def gold_tasks(tasks: DataFrame, successful: DataFrame) -> DataFrame:
    good = successful.select("task").distinct().withColumn("is_gold", F.lit(True))
    return tasks.distinct().join(good, "task", "left").select(
        "package", "task", F.coalesce("is_gold", F.lit(False)).alias("is_gold")
    )

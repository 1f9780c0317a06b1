"""Training samples, gold paths, graphs and knowledge on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gold import is_success
from ..schemas import IR_TASK, KNOWLEDGE, SAMPLE


def append_samples(rows: DataFrame, path: str) -> None:
    """Append JSON lines; every task of a round writes its own files."""
    rows.write.mode("append").json(path)


def read_samples(spark: SparkSession, paths: list[str], schema: str = SAMPLE) -> DataFrame:
    """All samples of the given rounds together."""
    return spark.read.schema(schema).json(paths)


def read_gold(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Gold entries of a JSON array file that count as successful."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    return rows.filter(is_success(F.col("success")))


def write_paths(chains: DataFrame, path: str) -> None:
    """Simplified paths as JSON lines, with their total in a side file."""
    chains.write.mode("overwrite").json(path + "/chains")
    written = chains.sparkSession.read.text(path + "/chains")  # one line a path, so the plan runs once
    written.agg(F.count(F.lit(1)).alias("total_chains")).write.mode("overwrite").json(path + "/total")


def write_graph(tables: dict[str, DataFrame], path: str, app: str = "app") -> None:
    """Graph tables, one folder per app."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").partitionBy(app).parquet(f"{path}/{name}")


def read_knowledge(spark: SparkSession, path: str, package: str | None = None) -> DataFrame:
    """Knowledge of one package, or the fused view of all."""
    rows = spark.read.schema(KNOWLEDGE).parquet(path)
    return rows if package is None else rows.filter(F.col("package") == package)


def read_ir_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task catalogue with its nested records."""
    return spark.read.schema(IR_TASK).json(path)

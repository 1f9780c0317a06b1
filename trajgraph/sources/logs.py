"""Append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollups import parse_progress

TOKEN_SCHEMA = (
    "timestamp string, package string, task string, stage string, prompt_tokens long, "
    "completion_tokens long, duration_seconds double"
)


def read_progress_log(spark: SparkSession, path: str) -> DataFrame:
    """Parsed progress lines with their file, so that several suites can be read at once."""
    return parse_progress(spark.read.text(path).withColumn("file", F.col("_metadata.file_path")))


def read_token_log(spark: SparkSession, path: str, schema: str = TOKEN_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def token_log_lines(rows: DataFrame) -> DataFrame:
    """One JSON line per stage; running totals are derived on read."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def append_token_log(rows: DataFrame, path: str) -> None:
    token_log_lines(rows).write.mode("append").text(path)

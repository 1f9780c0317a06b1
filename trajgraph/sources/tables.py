"""App tables: typed scan, insert with new keys, truncate, existence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordered import ordered_columns, row_number


def read_app_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    """Rows of an exported app table with declared types (parquet, csv, json or orc)."""
    return spark.read.schema(schema).options(**options).format(fmt).load(path)


def read_jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 32) -> DataFrame:
    """The same from a database; give a key and its bounds to read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def with_new_keys(existing: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows to insert with keys that follow the largest stored one."""
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    numbered = ordered_columns(rows.drop(key), [], order, [row_number("_n")])
    # ``top`` is one row.
    return (
        numbered.join(F.broadcast(top))
        .withColumn(key, (F.col("_n") + F.col("_top")).cast("long"))
        .select(*existing.columns)
    )


def insert_rows(existing: DataFrame, rows: DataFrame, key: str, order: list[str], path: str) -> None:
    with_new_keys(existing, rows, key, order).write.mode("append").parquet(path)


def truncate(table: DataFrame, path: str) -> None:
    """Delete all rows, keeping the schema."""
    table.limit(0).write.mode("overwrite").parquet(path)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)

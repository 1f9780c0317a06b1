"""Episode store: one partition per task instance, overwritten by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoints import durable, path_exists

#: Files without rows that are named to a reader one by one; more of them are found by a join.
MAX_QUIET = 1000


def save_episodes(episodes: DataFrame, path: str, key: str = "instance_name") -> None:
    """Write episodes; an instance that is saved again replaces its old rows.

    The partition is a hash bucket of the key, so the number of folders stays
    bounded; a replaced bucket keeps the other instances it holds.
    """
    buckets = episodes.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(64)).cast("int"))
    spark = episodes.sparkSession
    split = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 64)
    if path_exists(spark, path):
        touched = buckets.select("bucket").distinct()
        old = spark.read.parquet(path).join(touched, "bucket", "left_semi")
        kept = old.join(episodes.select(key).distinct(), key, "left_anti")
        # The buckets are read and replaced in one job, so the old rows go through
        # the checkpoint folder first.
        buckets = durable(kept.select(*buckets.columns).unionByName(buckets))
    (
        # Split by hash too, so that a bucket with very many rows is not one task.
        buckets.repartition("bucket", F.pmod(F.hash(*buckets.columns), F.lit(split)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


def load_episodes(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """All stored episodes, or only some fields; unreadable files are skipped and :func:`rejected_files` lists them."""
    rows = spark.read.option("ignoreCorruptFiles", "true").parquet(path).drop("bucket")
    return rows.select(*fields) if fields else rows


def load_counted(spark: SparkSession, path: str, fields: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`load_episodes`, and one row ``files, rejected`` that says how many files there are and how many were skipped."""
    files = _stored(spark, path)
    rejected = rejected_files(spark, path)
    counts = files.agg(F.count(F.lit(1)).alias("files")).join(rejected.agg(F.count(F.lit(1)).alias("rejected")))
    return load_episodes(spark, path, fields), counts


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of the stored files; a listing, which opens none of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.filter(F.col("path").endswith(".parquet"))


def rejected_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of every stored file that cannot be read as Parquet.

    A file that gives rows is fine, which takes its footer only.  The few others are empty or broken, which the
    marks at their ends tell.
    """
    rows = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    fine = rows.select(name(F.col("_metadata.file_path")).alias("name")).distinct()
    quiet = _stored(spark, path).withColumn("name", name(F.col("path"))).join(fine, "name", "left_anti")
    found = [r["path"] for r in quiet.select("path").limit(MAX_QUIET).collect()]
    if not found:
        return quiet.select("path")
    mark = F.lit("PAR1").cast("binary")
    whole = (F.substring("content", 1, 4) == mark) & (F.substring("content", -4, 4) == mark)
    if len(found) < MAX_QUIET:
        held = spark.read.format("binaryFile").load(found)
    else:
        held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        held = held.join(quiet.select("path"), "path", "left_semi")
    return held.filter(~whole).select("path")


def natural_order(name: str, separator: str = "_") -> list[Column]:
    """Sort columns for ``name_12``: the name, then its number (0 when it has none)."""
    parts = F.split(F.col(name), separator, 2)
    return [F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)).try_cast("long"), F.lit(0))]

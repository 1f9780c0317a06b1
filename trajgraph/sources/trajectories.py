"""Trajectory folders: ``<root>/<package>/<task>/<branch>/…`` with one step file each."""

from __future__ import annotations

import re
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoints import kept


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def listing(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """Files below ``root``: path and folder.  Only names are read, no contents."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
        .select("path")
    )
    return files.withColumn("folder", folder_of(F.col("path")))


def first_files(files: DataFrame) -> DataFrame:
    """The first file, by name, of every folder."""
    return files.groupBy("folder").agg(F.min("path").alias("path"))


def place(files: DataFrame, root: str) -> DataFrame:
    """Package, task, branch path and depth of each folder below ``root``."""
    # Folders may be named "key=value", as partitioned writers name them.
    below = F.regexp_replace("folder", f"^.*?{root.strip('/')}/", "")
    parts = F.split(F.regexp_replace(below, "(^|/)[^/=]*=", "$1"), "/")
    return files.select(
        "*",
        F.get(parts, F.lit(0)).alias("package"),
        F.get(parts, F.lit(1)).alias("task"),
        F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "/").alias("branch_path"),
        F.greatest(F.size(parts) - 2, F.lit(0)).alias("depth"),
    )


def leaf_folders(folders: DataFrame) -> DataFrame:
    """Folders that hold no other folder; ``folders(folder)``."""
    known = folders.select("folder").distinct()
    parents = known.select(folder_of(F.col("folder")).alias("folder"))
    return known.join(parents, "folder", "left_anti")


#: Files that one reader is given by name.
NAMED_FILES = 20_000


def read_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``path, value`` of just the files in ``files(path)``: their text as UTF-8.

    The names go to the readers in lists of bounded length, as the listing itself held them; no other file is opened.
    """
    names = (r["path"] for r in files.select("path").orderBy("path").toLocalIterator())
    plain = (re.sub(r"([*?\[\]{}\\])", r"\\\1", n) for n in names)  # signs of patterns stand for themselves
    out = None
    while batch := list(islice(plain, NAMED_FILES)):
        read = spark.read.format("binaryFile").load(batch).select("path", F.decode("content", "UTF-8").alias("value"))
        out = read if out is None else out.unionByName(read)
    return out if out is not None else spark.createDataFrame([], "path string, value string")


def read_trajectories(spark: SparkSession, root: str, schema: str, glob: str = "*.json", where: Column | None = None) -> DataFrame:
    """Ordered steps of the first file of every folder, with their place and leaf flag.

    Each file is one JSON array of steps; ``seq`` is a step's place in it.  The files are chosen from the listing, so
    those that are not the first of their folder, or whose ``package``, ``task``, ``branch_path`` or ``depth`` does not meet
    ``where``, are never opened.
    """
    files = listing(spark, root, glob)
    leaves = leaf_folders(files).withColumn("is_leaf", F.lit(True))
    chosen = place(first_files(files), root).join(leaves, "folder", "left").withColumn("is_leaf", F.coalesce("is_leaf", F.lit(False)))
    chosen = kept(chosen if where is None else chosen.filter(where), "trajectory-files")
    return read_files(spark, chosen).join(chosen, "path").select(
        "path", "folder", "package", "task", "branch_path", "depth", "is_leaf",
        F.posexplode(F.from_json("value", f"array<struct<{schema}>>")).alias("seq", "s"),
    ).select("*", "s.*").drop("s")


def flat_tasks(files: DataFrame) -> DataFrame:
    """Task folders that hold their trajectory directly: depth 0, and a leaf."""
    return files.filter(F.col("depth") == 0).withColumn("is_leaf", F.lit(True))

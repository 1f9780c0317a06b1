"""Reliable checkpoints for iterative operators.

Iterations cut their lineage into the shared folder that the cluster names in
``spark.checkpoint.dir``, so a lost executor never loses an iteration.
"""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, taking the session's own setting first."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="trajgraph-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and cut its lineage.

    Spark writes a checkpoint in a second job; the first one's rows are kept until then,
    so that the plan runs once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.DISK_ONLY)
    out = held.checkpoint(eager=True)
    held.unpersist()
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str]) -> DataFrame:
    """``df`` as a parquet table in the checkpoint folder, partitioned for pruning.

    A value of the partition columns may hold most rows, so its rows are split over as
    many tasks as a shuffle has.
    """
    folder = scratch(df.sparkSession, name)
    split = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(*partition_by, F.pmod(F.hash(*df.columns), F.lit(split))).write.partitionBy(
        *partition_by
    ).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a parquet table in the checkpoint folder: its plan runs once, whatever reads it afterwards."""
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a parquet table has been written at ``path``."""
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise

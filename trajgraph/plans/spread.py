"""Rows of small files for all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as there are cores if it comes in fewer splits.

    A table of one small file is one task for the costly work on its rows.  A table with at least as
    many splits as cores, which is any large one, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df

"""The query registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..plans.adapters import one_query


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(key: str, sql: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` under ``key`` with its check SQL."""

    def add(fn):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with one_query():
                return fn(spark, sf_dir)

        REGISTRY[key] = Entry(run, sql)
        return fn

    return add

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoints import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read again.

    Unlike ``checkpoint`` this runs the plan once. The folder is the one the cluster names, so a lost executor loses nothing.
    """
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def by_value(module: str) -> None:
    """Ship the functions of ``module`` to workers inside the plan, so that workers need no package path."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that do not clash with those of ``df``, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def only(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Just the named columns, so that extra columns of the input can clash with nothing."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunked(items: Column) -> Column:
    """An array cut into about as many pieces as each of them has elements; an empty one gives none.

    What a fold over n elements builds by appending is copied n times; over pieces it is copied as often as a piece is long.
    """
    step = F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int")
    starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.greatest(step, F.lit(1)))
    cut = F.transform(starts, lambda s: F.slice(items, s, F.greatest(step, F.lit(1))))
    return F.filter(cut, lambda c: F.size(c) > 0)


def running(totals: Column, start: Column) -> Column:
    """What stands before each of a few totals: ``start``, then the sum so far."""
    zero = F.struct(start.alias("sum"), F.array().cast("array<int>").alias("before"))
    step = lambda acc, x: F.struct((acc["sum"] + x).cast("int").alias("sum"), F.concat(acc["before"], F.array(acc["sum"])).alias("before"))
    return F.aggregate(totals, zero, step)["before"]


Query = Callable[[SparkSession, str], DataFrame]

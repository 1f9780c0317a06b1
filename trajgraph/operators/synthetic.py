"""Seeded rows from value pools, and states assembled from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import ordered_columns, row_number


def seeded(key: Column, name: str, seed: int) -> Column:
    """Stable number in 0 … 2³²−1 for a row, a column name and a seed."""
    text = F.concat_ws("_", F.lit(str(seed)), F.lit(name), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def instance_seed(seed: Column, name: Column, i: Column) -> Column:
    """Seed of a task instance: the digest of ``seed_name_i`` modulo 2³²."""
    text = F.concat_ws("_", seed.cast("string"), name, i.cast("string"))
    return F.conv(F.right(F.sha2(text, 256), F.lit(8)), 16, 10).cast("long")


def pick(values: list, key: Column, name: str, seed: int) -> Column:
    """Value of a short literal pool for each row."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(seeded(key, name, seed), F.lit(len(values))) + 1).cast("int"))


def pick_between(low: int, high: int, key: Column, name: str, seed: int) -> Column:
    return F.lit(low) + F.pmod(seeded(key, name, seed), F.lit(high - low + 1))


def draw(rows: DataFrame, key: str, pool: DataFrame, value: str, name: str, seed: int) -> DataFrame:
    """Add a column drawn from a pool table, by an equi join on the drawn position."""
    distinct = pool.select(F.col(value).alias(name)).distinct()
    indexed = ordered_columns(distinct, [], [name], [row_number("_i")])
    n = distinct.count()
    return (
        rows.withColumn("_i", F.pmod(seeded(F.col(key), name, seed), F.lit(n)) + 1)
        .join(indexed, "_i")
        .drop("_i")
    )


def random_rows(rows: DataFrame, key: str, columns: list[str], n: int, keep: Column | None = None, replacement: bool = False) -> DataFrame:
    """The first ``n`` generated rows that pass ``keep``, distinct unless with replacement.

    ``rows`` are the candidates (over-generated); too few of them is an error at
    run time, as generation is then exhausted.
    """
    good = rows if keep is None else rows.filter(keep)
    if not replacement:
        good = good.groupBy(*columns).agg(F.min(key).alias(key))
    out = good.orderBy(key).limit(n)
    enough = out.agg(F.count(F.lit(1)).alias("_n"))
    check = F.when(F.col("_n") < n, F.raise_error(F.lit("generation exhausted"))).otherwise(F.lit(True))
    return out.join(F.broadcast(enough.select(check.alias("_ok")))).filter("_ok").drop("_ok")


def split_sum(total: Column, cuts: Column) -> Column:
    """Non-negative parts that add up to ``total``: gaps between sorted cut points."""
    points = F.array_sort(F.concat(F.array(F.lit(0).cast("long")), cuts, F.array(total.cast("long"))))
    return F.zip_with(
        F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda a, b: b - a
    )


def fill_template(text: Column, params: Column) -> Column:
    """Replace every ``{name}`` by its value from a map."""
    return F.aggregate(
        F.map_entries(params),
        text,
        lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]),
    )


def fill_fields(rows: DataFrame, fields: list[str], params: str) -> DataFrame:
    """Fill the templates of several string fields; arrays of strings element by element."""
    out = {}
    for f in fields:
        kind = rows.schema[f].dataType.typeName()
        if kind == "array":
            out[f] = F.transform(f, lambda t: fill_template(t, F.col(params)))
        else:
            out[f] = fill_template(F.col(f), F.col(params))
    return rows.withColumns(out)


def unused_value(rows: DataFrame, used: DataFrame, pool: DataFrame, seed: int) -> DataFrame:
    """A pool value not used yet, per group: the first in a stable hash order.

    ``rows(group)``, ``used(group, value)``, ``pool(group, value)``.
    """
    free = pool.join(used, ["group", "value"], "left_anti")
    order = F.struct(seeded(F.concat_ws("/", "group", "value"), "free", seed).alias("h"), "value")
    best = free.groupBy("group").agg(F.min_by("value", order).alias("value"))
    return rows.join(best, "group", "left")


def assemble_state(required: DataFrame, generated: DataFrame, key: str, seed: int) -> DataFrame:
    """Required rows and generated ones, with a shuffled position column."""
    both = required.withColumn("required", F.lit(True)).unionByName(generated.withColumn("required", F.lit(False)))
    return both.withColumn("shuffle_key", seeded(F.col(key), "shuffle", seed))


def modified_file_name(name: Column, key: Column, seed: int) -> Column:
    """File name with a word put before or after its stem, ahead of the extension."""
    # The words of the fixed suffixes.
    word = pick(["backup", "copy", "final", "edited"], key, "word", seed)
    stem = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1)
    ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    front = pick([True, False], key, "front", seed)
    return F.when(front, F.concat(word, F.lit("_"), stem, ext)).otherwise(F.concat(stem, F.lit("_"), word, ext))


def october_epoch(key: Column, start_day: int, end_day: int, start_hour: int, seed: int) -> Column:
    """Epoch seconds of a random hour in October 2023."""
    day = pick_between(start_day, end_day, key, "day", seed)
    hour = pick_between(start_hour, 23, key, "hour", seed)
    return F.unix_seconds(F.make_timestamp(F.lit(2023), F.lit(10), day.cast("int"), hour.cast("int"), F.lit(0), F.lit(0)))

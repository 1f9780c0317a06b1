"""Row filters over steps, UI elements and task lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import Names
from ..plans.checkpoints import kept
from ..plans.spread import spread


def actionable_steps(steps: DataFrame) -> DataFrame:
    """Steps that knowledge mining can use: an element index and a target element."""
    return steps.filter(F.col("element_index").isNotNull() & F.col("target_element").isNotNull())


def valid_element(width: Column, height: Column, box: str = "bbox_pixels", visible: str = "is_visible") -> Column:
    """Visible, and its box, if there is one, has an area and touches the screen."""
    b = F.col(box)
    outside = (
        (b["x_min"] >= b["x_max"]) | (b["x_min"] >= width) | (b["x_max"] <= 0)
        | (b["y_min"] >= b["y_max"]) | (b["y_min"] >= height) | (b["y_max"] <= 0)
    )
    return F.coalesce(F.col(visible), F.lit(False)) & (b.isNull() | ~F.coalesce(outside, F.lit(False)))


def describable_element() -> Column:
    """Has a class and any of text, description, hint or resource."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    any_text = reduce(lambda a, b: a | b, map(filled, ("text", "content_description", "hint_text", "resource_name")))
    return filled("class_name") & any_text


def interactable_element() -> Column:
    """Clickable, scrollable, long-clickable or editable; null counts as false."""
    flags = ("is_clickable", "is_scrollable", "is_long_clickable", "is_editable")
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(False)) for c in flags])


def letter_index(i: Column) -> Column:
    """A … Z, then AA … ZZ, for an index from 0; past 702 options it is an error."""
    letter = lambda n: F.char(n + 65)
    two = F.concat(letter(F.floor((i - 26) / 26)), letter(F.pmod(i - 26, F.lit(26))))
    return F.when(i > 26 * 26, F.raise_error(F.lit("more than 676 options"))).when(i < 26, letter(i)).otherwise(two)


def screen_flag(elements: DataFrame, prefix: str) -> DataFrame:
    """Whether any element text of a screen starts with ``prefix``."""
    return elements.groupBy("screen_id").agg(
        F.max(F.coalesce(F.col("text").startswith(prefix), F.lit(False))).alias("flagged")
    )


OPS = {
    "=": lambda a, b: a == b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "contains": lambda a, b: a.cast("string").contains(b),
}


def compare(value: Column, op: str, other: Column) -> Column:
    if op not in OPS:
        raise ValueError(f"unknown operator {op!r}")
    return OPS[op](value, other)


def exclusion_filter(rows: DataFrame, conditions: list[tuple[str, str, object]], text: tuple[str, ...] = ()) -> DataFrame:
    """Keep rows unless all conditions ``(field, op, value)`` hold.

    No conditions keep every row.  A condition on an unknown field counts as met,
    so a list of only such conditions excludes everything.  ``text`` fields are
    compared in lower case.  The conditions become one predicate, which Spark can
    push to the scan.
    """
    if not conditions:
        return rows
    met = F.lit(True)
    for field, op, value in conditions:
        if field not in rows.columns:
            continue
        left, right = F.col(field), F.lit(value)
        if field in text:
            left, right = F.lower(left), F.lower(right)
        met = met & compare(left, op, right)
    return rows.filter(~F.coalesce(met, F.lit(False)))


def exclude_events(events: DataFrame, conditions: list[tuple[str, str, object]]) -> DataFrame:
    """Exclusion filter of calendar events ``start_ts, end_ts, title``.

    An equal date (or time) holds when the event's interval covers it; any other
    operator holds when the start or the end satisfies it.  An equal date and an
    equal time together mean one point in time.
    """
    if not conditions:
        return events
    start, end = F.col("start_ts"), F.col("end_ts")
    equal = {f: v for f, op, v in conditions if op == "="}
    point = None
    if "start_date" in equal and "start_time" in equal:
        point = F.to_timestamp(F.lit(f"{equal['start_date']} {equal['start_time']}"))
    clock = lambda t: F.date_format(t, "HH:mm")
    met = F.lit(True)
    for field, op, value in conditions:
        if field == "title":
            met = met & compare(F.lower("title"), op, F.lower(F.lit(value)))
            continue
        if field not in ("start_date", "start_time"):
            continue
        if point is not None:
            lo, hi, want = start, end, point
        elif field == "start_date":
            lo, hi, want = F.to_date(start), F.to_date(end), F.to_date(F.lit(value))
        else:
            lo, hi, want = clock(start), clock(end), F.lit(value)
        if op == "=":
            met = met & (lo <= want) & (hi >= want)
        else:
            met = met & (compare(lo, op, want) | compare(hi, op, want))
    return events.filter(~met)


def subset(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return rows.join(wanted.select(key), key, "left_semi")


#: Bytes of known names that are sent to the tasks at once.
NAME_BYTES = 16_000_000


def unknown_names(wanted: DataFrame, known: DataFrame, threshold: int = 80, name_bytes: int = NAME_BYTES) -> DataFrame:
    """Names nobody knows, each with the known name of the highest weighted ratio if that is at least ``threshold``.

    ``wanted(name)``, ``known(name)``.  Ties go to the smaller known name.  Known names whose bytes are counted
    first are sent to the tasks that hold the unknown ones, in blocks if they are many.
    """
    missing = wanted.select("name").distinct().join(known, "name", "left_anti")
    listed = known.select(F.col("name").alias("k")).filter("k IS NOT NULL").distinct()
    # A profile of numbers lies beside each name.
    size = listed.agg(F.coalesce(F.sum(F.octet_length("k") + 700), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // name_bytes))
    listed = kept(listed.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks))), "known-names")
    asked = kept(spread(missing, "name"), "unknown-names")
    best = None
    for block in range(blocks):
        found = _suggested(asked, [r.k for r in listed.filter(F.col("block") == block).collect()], threshold)
        best = found if best is None else best.unionByName(found)
    top = best.groupBy("name").agg(F.min_by("k", F.struct((-F.col("score")).alias("s"), "k")).alias("suggestion"))
    return asked.join(top, "name", "left")


def _suggested(names: DataFrame, known: list[str], threshold: int) -> DataFrame:
    held = names.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        import pyarrow as pa

        table = Names(held.value)
        for batch in batches:
            found = [(n, table.best(n, threshold)) for n in batch.column(0).to_pylist() if n is not None]
            found = [(n, *b) for n, b in found if b]
            kinds = (pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names=["name", "score", "k"])

    return names.select("name").mapInArrow(run, "name string, score int, k string")


def without_titles(noise: DataFrame, targets: DataFrame, title: str = "title") -> DataFrame:
    return noise.join(targets.select(title), title, "left_anti")

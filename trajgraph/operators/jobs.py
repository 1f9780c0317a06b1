"""Table-to-table jobs built from the parsing rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import parsing as P
from ..functions.udfs import extract_json, parse_call


def reply_ingest(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed columns of model replies, and the replies without reason and action.

    ``replies(reply_id, source, text)``.  Cheap patterns run in the JVM; the call and JSON
    parsers see only the short action text.
    """
    parsed = replies.withColumn("_ra", P.reason_action(F.col("text"))).select(
        "*", F.col("_ra.reason").alias("reason"), F.col("_ra.action").alias("action")
    ).drop("_ra")
    good = parsed.filter(F.col("reason").isNotNull() & F.col("action").isNotNull())
    good = good.withColumns(
        {
            "call": parse_call(F.col("action")),
            "json": extract_json(F.col("action")),
            "flag": P.completion_flag(F.col("text")),
        }
    )
    bad = parsed.filter(F.col("reason").isNull() | F.col("action").isNull()).select("reply_id", "source", "text")
    return good.drop("text"), bad


def parse_rate(replies: DataFrame) -> DataFrame:
    """Share of replies per source that have a reason and an action."""
    ra = P.reason_action(F.col("text"))
    ok = (ra["reason"].isNotNull() & ra["action"].isNotNull()).cast("double")
    return replies.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(ok).alias("rate"))


def dump_messages(dumps: DataFrame, column: str) -> DataFrame:
    """Deduplicated messages of content dumps."""
    rows = dumps.select(F.explode(P.split_rows(F.col(column))).alias("raw"))
    return rows.select(P.sms_fields(F.col("raw")).alias("m")).select("m.*").dropDuplicates(["id", "address", "date_ms"])


def dump_contacts(dumps: DataFrame, column: str) -> DataFrame:
    return dumps.select(F.explode(P.contact_rows(F.col(column))).alias("c")).select("c.*").distinct()


def dump_files(dumps: DataFrame, column: str) -> DataFrame:
    lines = dumps.select(F.explode(F.split(column, "\n")).alias("line"))
    return lines.select(P.file_listing(F.col("line")).alias("f")).filter(F.col("f").isNotNull()).select("f.*").distinct()


def time_normalise(rows: DataFrame, date: str, time: str, duration: str) -> DataFrame:
    """Typed start, end and length columns from text dates, times and durations."""
    start = D.to_epoch(F.col(date), F.col(time))
    seconds = D.parse_duration(F.col(duration))
    return rows.withColumns({"start_s": start, "duration_s": seconds}).withColumn(
        "end_s", F.col("start_s") + F.col("duration_s")
    )


# Defaults of app rows made from text records.
DEFAULT_DURATION_S = 1800
DEFAULT_IMPORTANCE = 2
CREATED_BEFORE_DUE = 7 * 3600


def event_rows(records: DataFrame) -> DataFrame:
    """Calendar rows from text records."""
    start = D.to_epoch(F.col("start_date"), F.col("start_time"))
    length = F.when(F.col("duration").isNull(), DEFAULT_DURATION_S).otherwise(D.parse_duration(F.col("duration")))
    return records.select(
        start.alias("start_ts"), (start + length).alias("end_ts"), "title",
        F.coalesce("location", F.lit("")).alias("location"), F.coalesce("description", F.lit("")).alias("description"),
    )


def task_rows(records: DataFrame) -> DataFrame:
    """Task rows (milliseconds) from text records; missing dates are 0."""

    def stamp(day, clock):
        return F.when(F.col(day).isNull(), F.lit(0).cast("long")).otherwise(D.to_epoch(F.col(day), F.col(clock)) * 1000)

    due = stamp("due_date", "due_time")
    created = due - CREATED_BEFORE_DUE
    return records.select(
        "title",
        F.coalesce(F.col("importance").try_cast("int"), F.lit(DEFAULT_IMPORTANCE)).alias("importance"),
        due.alias("dueDate"),
        stamp("hide_until_date", "hide_until_time").alias("hideUntil"),
        stamp("completed_date", "completed_time").alias("completed"),
        created.alias("created"),
        created.alias("modified"),
        "notes",
    )


def activity_rows(records: DataFrame) -> DataFrame:
    """Activity rows (milliseconds) from text records."""
    start = D.to_epoch(F.col("start_date"), F.col("start_time")) * 1000
    total = (F.col("duration").try_cast("double") * 60 * 1000).cast("long")
    distance = D.rounded_metres(F.col("total_distance").try_cast("double"))
    number = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0))
    return records.select(
        "name",
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("description", F.lit("")).alias("description"),
        distance.alias("totaldistance"),
        start.alias("starttime"),
        (start + total).alias("stoptime"),
        total.alias("totaltime"),
        (distance / (total * 1000)).alias("avgspeed"),
        number("elevation_gain").alias("elevationgain"),
        number("elevation_loss").alias("elevationloss"),
    )


def note_rows(records: DataFrame, folders: DataFrame) -> DataFrame:
    """Note rows; ``folders(folder, parent_id)``."""
    flag = lambda c: (F.lower(F.coalesce(F.col(c), F.lit(""))) == "true").cast("int")
    return records.join(folders, "folder", "left").select(
        "parent_id", F.lower("title").alias("title"), "body",
        flag("is_todo").alias("is_todo"), flag("todo_completed").alias("todo_completed"),
    )


# Expense categories by id.
EXPENSE_CATEGORIES = {
    1: "Others",
    2: "Income",
    3: "Food",
    4: "Housing",
    5: "Social",
    6: "Entertainment",
    7: "Transportation",
    8: "Clothes",
    9: "Health Care",
    10: "Education",
    11: "Donation",
}


def category_name(category):
    pairs = [x for k, v in EXPENSE_CATEGORIES.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), category)


def duration_minutes(start, end):
    """Whole minutes between two epochs; anything else is an error."""
    seconds = end - start
    return F.when(F.pmod(seconds, F.lit(60)) == 0, (seconds / 60).cast("long")).otherwise(
        F.raise_error(F.lit("duration is not a whole number of minutes"))
    )


def csv_rows(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Pipe-separated text of the chosen fields; a missing value reads ``None``."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("None")) for f in fields]
    return rows.select(F.concat_ws("|", *parts).alias("value"))


def text_blocks(rows: DataFrame, kind: str, title: str, fields: list[str]) -> DataFrame:
    """Readable block per row: its title, then one indented line per other field."""
    text = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("None"))
    lines = [F.concat(F.lit(f" {f}: "), text(f), F.lit("\n")) for f in fields if f != title]
    return rows.select(F.concat(F.lit(f"{kind}: "), text(title), F.lit("\n"), *lines).alias("value"))


def families(members: DataFrame, family: str, known: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows of the registries a family name stands for; an unknown family is an error."""
    if family not in known:
        raise ValueError(f"unsupported family: {family}")
    return members.filter(F.col("registry").isin(*known[family]))

"""Text rules as column expressions: replies, device dumps, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Text without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _group(text: Column, pattern: str, i: int = 1) -> Column:
    """Group of the first match, null without one; may be empty when matched."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, i))


# Patterns of the device dumps and model replies these rules read.
SMS_BODY = r"(?s)body=([^=]*), [^=]*="
SMS_BODY_LAST = r"(?s)body=([^=]*)$"
SUBGOAL = r"Sub-goal\s+(\d+):\s*\nAnchor:\s*(.+?)\nDirective:\s*(.+?)\nConfidence:\s*([\d.]+)"
TASK_LINE = r"\d+\.+(.*)"
RESULT_FLAG = r"(?i)Result:\s*(True|False)"
STATE_REASON = r"(?s)Reasoning:\s*(.*?)\s*Result:"
STATE_RESULT = r"Result:\s*(CONTINUE|BACKTRACK|COMPLETED)"
REASON = r"(?s)Reasoning:(.*)Action:"
ACTION = r"(?s)Action:(.*)"
PATH_TAG = r"(?s)<PATH>(.*?)</PATH>"
JSON_FENCE = r"(?s)```json\s*(.*?)\s*```"
JSON_OBJECT = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
JSON_OUTER = r"(?s)\{.*\}"
NUMBER = r"-?\d*\.?\d+"
CONTACT = r"display_name=(.*), number=(.*)"
LISTING = r"^-\S*\s+\S+\s+\S+\s+\S+\s+(\d+)\s+(\S+)\s+(\S+)\s+\S+\s+(.*)$"


def sms_fields(row: Column) -> Column:
    """Id, address, body and date of a message row; commas may occur in the body."""
    row = strip(row)
    body = F.coalesce(_group(row, SMS_BODY), _group(row, SMS_BODY_LAST))
    rest = F.regexp_replace(row, r"(?s)body=([^=]*)(, [^=]*=|$)", "$2")

    def field(name):
        return strip(_group(rest, rf"(?:^|, |\s){name}=([^,]*)"))

    return F.struct(
        field("_id").try_cast("long").alias("id"),
        field("address").alias("address"),
        body.alias("body"),
        field("date").try_cast("long").alias("date_ms"),
    )


def split_rows(dump: Column) -> Column:
    """Rows of a content dump; ``No result found.`` means none."""
    clean = F.regexp_replace(dump, "\r", "")
    return F.when(clean.startswith("No result found."), F.array().cast("array<string>")).otherwise(
        F.split(dump, "\n(?=Row:)")
    )


def contact_rows(dump: Column) -> Column:
    """(name, digits) structs of every contact line."""
    names, numbers = F.regexp_extract_all(dump, F.lit(CONTACT), 1), F.regexp_extract_all(dump, F.lit(CONTACT), 2)
    return F.zip_with(
        names, numbers, lambda a, b: F.struct(a.alias("name"), F.regexp_replace(b, r"\D", "").alias("number"))
    )


def file_listing(line: Column) -> Column:
    """Name, size and change time of a long listing line; null for other lines."""
    stamp = F.concat_ws(" ", F.regexp_extract(line, LISTING, 2), F.substring(F.regexp_extract(line, LISTING, 3), 1, 15))
    return F.when(
        line.rlike(LISTING),
        F.struct(
            strip(F.regexp_extract(line, LISTING, 4)).alias("name"),
            F.regexp_extract(line, LISTING, 1).try_cast("long").alias("size"),
            F.try_to_timestamp(stamp).alias("changed"),
        ),
    )


def reason_action(text: Column) -> Column:
    return F.struct(
        strip(_group(text, REASON)).alias("reason"), strip(_group(text, ACTION)).alias("action")
    )


def subgoals(text: Column) -> Column:
    parts = [F.regexp_extract_all(text, F.lit(SUBGOAL), i) for i in (1, 2, 3, 4)]
    return F.transform(
        F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("id", "anchor", "directive", "confidence"))]),
        lambda r: F.struct(
            r["id"].cast("int").alias("id"),
            strip(r["anchor"]).alias("anchor"),
            strip(r["directive"]).alias("directive"),
            r["confidence"].try_cast("double").alias("confidence"),
        ),
    )


def numbered_tasks(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TASK_LINE), 1), lambda t: strip(t))


def completion_flag(text: Column) -> Column:
    """true / false of ``Result: …``, null when it is missing."""
    return F.lower(_group(text, RESULT_FLAG)) == "true"


def state_evaluation(text: Column) -> Column:
    return F.struct(
        F.coalesce(strip(_group(text, STATE_REASON)), F.lit("")).alias("reasoning"),
        F.coalesce(_group(text, STATE_RESULT), F.lit("CONTINUE")).alias("result"),
    )


def element_action_value(text: Column) -> Column:
    """Last ELEMENT / ACTION / VALUE lines of a reply."""

    def last(name):
        lines = F.filter(F.split(text, "\n"), lambda s: s.startswith(f"{name}:"))
        return F.get(F.split(F.element_at(F.concat(F.array(F.lit(None).cast("string")), lines), -1), ":"), F.lit(1))

    element = strip(last("ELEMENT"))
    return F.struct(
        F.nullif(element, F.lit("None")).alias("element"),
        strip(last("ACTION")).alias("action"),
        F.regexp_replace(strip(last("VALUE")), r"^\.+|\.+$", "").alias("value"),
    )


def comparison_json(text: Column) -> Column:
    """First object with ``is_same_page``: the verdict and the matched candidate."""
    objects = F.regexp_extract_all(text, F.lit(JSON_OBJECT), 0)
    having = F.filter(objects, lambda s: F.get_json_object(s, "$.is_same_page").isNotNull())
    first = F.get(having, F.lit(0))
    return F.struct(
        F.coalesce(F.get_json_object(first, "$.is_same_page") == "true", F.lit(False)).alias("same_page"),
        F.get_json_object(first, "$.matched_candidate_index").try_cast("int").alias("candidate"),
    )


def path_tag(text: Column) -> Column:
    """Text between the path tags, else the whole text."""
    return strip(F.coalesce(_group(text, PATH_TAG), text))


def plan_json(text: Column) -> Column:
    """Task sequence of a plan: JSON in a fence, else the whole reply."""
    return F.get_json_object(F.coalesce(_group(text, JSON_FENCE), strip(text)), "$.task_execution_sequence")


def decision(text: Column) -> Column:
    """Whether the text after the first ``decision:`` starts with true."""
    after = strip(F.get(F.split(F.lower(text), "decision:"), F.lit(1)))
    return F.coalesce(after.startswith("true"), F.lit(False))


def coords(text: Column) -> Column:
    """(lat, lon) when the text holds exactly two numbers, else null."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), 0)
    return F.when(
        F.size(found) == 2,
        F.struct(F.get(found, F.lit(0)).cast("double").alias("lat"), F.get(found, F.lit(1)).cast("double").alias("lon")),
    )


def steps_of(value: Column, task: Column) -> Column:
    """Sorted steps a node's stored task value gives for a task.

    The value is a JSON map task → steps; the older JSON list of names counts as
    step 0; anything else has none.
    """
    as_map = F.from_json(value, "map<string,array<int>>")
    as_list = F.from_json(value, "array<string>")
    none = F.array().cast("array<int>")
    return F.when(strip(value).startswith("["), F.when(F.array_contains(as_list, task), F.array(F.lit(0))).otherwise(none)).otherwise(
        F.coalesce(F.array_sort(F.array_distinct(F.try_element_at(as_map, task))), none)
    )


def action_equal(a: dict[str, Column], b: dict[str, Column], folded=("text", "app_name")) -> Column:
    """Null-safe equality of two actions field by field; text fields ignore case."""
    out = F.lit(True)
    for name, left in a.items():
        right = b[name]
        if name in folded:
            left, right = F.lower(left), F.lower(right)
        out = out & left.eqNullSafe(right)
    return out

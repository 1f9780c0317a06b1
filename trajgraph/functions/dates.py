"""Dates, times and durations as text and as typed columns (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The frozen "now" of the graded devices.
NOW_DATE = "2023-10-15"
NOW_TIME = "15:34"

DATE_FORMAT = "MMMM d yyyy"


def parse_date(text: Column) -> Column:
    """``October 15 2023`` as a date; null for anything else."""
    return F.to_date(F.try_to_timestamp(text, F.lit(DATE_FORMAT)))


def parse_time(text: Column) -> Column:
    """Seconds of the day of ``15:30``, ``3:30pm`` or ``3pm``; null for anything else."""
    low = F.lower(text)
    pattern = r"^(\d{1,2})(?::(\d{1,2}))?(am|pm)?$"
    hour = F.regexp_extract(low, pattern, 1).try_cast("int")
    minute = F.regexp_extract(low, pattern, 2)
    half = F.regexp_extract(low, pattern, 3)
    minutes = F.coalesce(minute.try_cast("int"), F.lit(0))
    clock12 = F.pmod(hour, F.lit(12)) + F.when(half == "pm", 12).otherwise(0)
    good24 = (half == "") & (minute != "") & hour.between(0, 23)
    good12 = (half != "") & hour.between(1, 12)
    value = F.when(good24, hour).when(good12, clock12)
    return F.when(minutes.between(0, 59), value * 3600 + minutes * 60)


def parse_duration(text: Column) -> Column:
    """Seconds of ``2h``, ``1.5 hours`` or ``30m``; null for anything else."""
    hours = F.trim(F.substring_index(text, "h", 1)).try_cast("double")
    minutes = F.trim(F.substring_index(text, "m", 1)).try_cast("int")
    return F.when(text.contains("h"), (hours * 3600).cast("long")).when(
        text.contains("m"), (minutes * 60).cast("long")
    )


def to_epoch(date_text: Column, time_text: Column, zone: str = "UTC") -> Column:
    """Epoch seconds of a date and a time; a missing date is the frozen today."""
    day = F.coalesce(parse_date(date_text), F.to_date(F.lit(NOW_DATE)))
    seconds = F.coalesce(parse_time(time_text), F.lit(0))
    local = F.to_timestamp(day) + F.make_dt_interval(secs=seconds)
    return F.unix_seconds(F.to_utc_timestamp(local, zone))


def localise(epoch: Column, zone: str = "UTC") -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(epoch), zone)


def date_options(day: Column, today: str = NOW_DATE) -> Column:
    """Ways to word a date relative to today."""
    gap = F.datediff(day, F.to_date(F.lit(today)))
    name = F.date_format(day, "EEEE")
    options = [
        F.date_format(day, "MMMM dd"),
        F.date_format(day, "MMMM dd yyyy"),
        F.when(gap == 0, F.lit("today")),
        F.when(gap == 1, F.lit("tomorrow")),
        F.when(gap == -1, F.lit("yesterday")),
        F.when(gap.between(1, 7) | gap.between(-7, -1), name),
        F.when(gap.between(1, 7), F.concat(F.lit("this "), name)),
        F.when(gap.between(8, 14), F.concat(F.lit("the "), name, F.lit(" after next"))),
    ]
    return F.array_compact(F.array(*options))


def weekly_bitmask(day: Column) -> Column:
    """Repeat rule bit of a weekday, Monday = 1; out of range is an error."""
    checked = F.when(day.between(1, 7), day - 1).otherwise(F.raise_error(F.lit("weekday out of range")))
    return F.pow(F.lit(2), checked).cast("int")


def rounded_metres(metres: Column) -> Column:
    """Metres as shown in miles with two decimals, back in whole metres (half to even)."""
    # Fixed value: metres per mile.
    mile = 1609.34
    return F.bround(F.bround(metres * (1.0 / mile), 2) * mile)


def combine_date_time(a: Column, b: Column) -> Column:
    """Timestamp of a date text and a time text given in either order."""
    day = F.coalesce(parse_date(a), parse_date(b))
    clock = F.coalesce(parse_time(b), parse_time(a))
    return F.to_timestamp(day) + F.make_dt_interval(secs=clock)

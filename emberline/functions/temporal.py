"""Times: seconds between events, open intervals, parts of a date, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_s(ts: Column) -> Column:
    """Whole seconds since 1970 of a wall-clock time, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a wall-clock time, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def seconds_apart(a: Column, b: Column) -> Column:
    return F.abs(epoch_s(a) - epoch_s(b))


def active_at(start: Column, end: Column, at: Column) -> Column:
    """Whether a closed interval holds a time; a null end is still open."""
    return (start <= at) & (end.isNull() | (end >= at))


def detection_time(date: Column, hhmm: Column) -> Column:
    """The time of a date and a number like 130 (01:30); null if that is no time."""
    text = F.concat_ws(" ", date.cast("date").cast("string"), F.lpad(hhmm.cast("string"), 4, "0"))
    parsed = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HHmm"))
    return F.when(date.isNotNull() & hhmm.isNotNull(), parsed)


def date_parts(ts: Column) -> dict[str, Column]:
    return {"detection_date": F.to_date(ts), "detection_year": F.year(ts), "detection_month": F.month(ts), "detection_day": F.day(ts), "detection_hour": F.hour(ts), "detection_minute": F.minute(ts)}

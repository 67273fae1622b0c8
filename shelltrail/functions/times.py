"""Column expressions over timestamps. "Now" is always the explicit ``as_of``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def moment(as_of: Column | str | dt.datetime) -> Column:
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("timestamp")


def hours_before(as_of, hours: int) -> Column:
    return moment(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)


def age_hours(since: Column, as_of) -> Column:
    return seconds_between(since, moment(as_of)) / 3600.0


def duration_ms() -> Column:
    """Whole milliseconds between start and end, cut toward zero."""
    micros = F.unix_micros("end_timestamp") - F.unix_micros("start_timestamp")
    return (micros / F.lit(1000)).cast("long")


def time_ago(since: Column, as_of) -> Column:
    hours = age_hours(since, as_of)
    days = F.floor(hours / 24)
    return (
        F.when(hours < 1, F.format_string("%s min ago", F.bround(hours * 60, 0).cast("long").cast("string")))
        .when(hours < 24, F.format_string("%s hours ago", F.bround(hours, 0).cast("long").cast("string")))
        .when(days == 1, F.lit("1 day ago"))
        .otherwise(F.format_string("%s days ago", days.cast("string")))
    )


def wire_time(stamp: Column) -> Column:
    """RFC 3339 in UTC without trailing zeros, as events carry it on the wire."""
    text = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0+\z", ""), F.lit("Z"))

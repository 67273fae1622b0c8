"""Counts over the log. All of them combine on the map side, so hot values cost nothing extra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelltrail.functions.text import command_name, is_blank
from shelltrail.functions.times import moment
from shelltrail.operators.filters import filter_time_range, has_hashed_env
from shelltrail.schema import event_time


def count_rows() -> Column:
    return F.count(F.lit(1))


def return_code_distribution(events: DataFrame) -> DataFrame:
    return events.groupBy("return_code").agg(count_rows().alias("n"))


def commands_over_time(events: DataFrame, interval: str = "1 hour") -> DataFrame:
    counted = events.groupBy(F.window("start_timestamp", interval).alias("_w")).agg(count_rows().alias("n"))
    return counted.select(F.col("_w.start").alias("bucket"), "n")


def top_commands(events: DataFrame, n: int = 10, longest: int | None = None) -> DataFrame:
    """Whole command texts by count; with ``longest`` texts beyond that many characters are left out."""
    counted = events.where(F.col("command").isNotNull())
    return (
        (counted if longest is None else counted.where(F.length("command") <= longest))
        .groupBy("command")
        .agg(count_rows().alias("n"))
        .orderBy(F.desc("n"), "command")
        .limit(n)
    )


def named_commands(events: DataFrame) -> DataFrame:
    """Events with a command, and its first word as ``command_name``."""
    return events.where(F.col("command").isNotNull() & ~is_blank(F.col("command"))).withColumn(
        "command_name", command_name(F.col("command"))
    )


def command_name_frequency(events: DataFrame, n: int = 100) -> DataFrame:
    """The most frequent command names; the one seen first wins a tie."""
    return (
        named_commands(events)
        .groupBy("command_name")
        .agg(count_rows().alias("n"), F.min(event_time()).alias("first_seen"))
        .orderBy(F.desc("n"), "first_seen", "command_name")
        .limit(n)
    )


def time_unit(unit: str, as_of=None) -> Column:
    """Hour 0-23 or weekday with Monday as 0; an event without a time counts as one of ``as_of``, or else as 0."""
    at = event_time() if as_of is None else F.coalesce(event_time(), moment(as_of))
    return F.coalesce({"hour": F.hour, "weekday": F.weekday}[unit](at), F.lit(0))


def time_weights(events: DataFrame, unit: str) -> DataFrame:
    """The share of commands per hour or weekday."""
    named = events.where(F.col("command").isNotNull() & ~is_blank(F.col("command")))
    counted = named.groupBy(time_unit(unit).alias(unit)).agg(count_rows().alias("n"))
    # At most 24 rows are left here, so one window over all of them is fine.
    everything = Window.partitionBy(F.lit(0))
    return counted.select(unit, (F.col("n") / F.sum("n").over(everything)).alias("weight"))


def share_within(pairs: DataFrame, given: str, name: str = "probability") -> DataFrame:
    """``n`` as a share of all ``n`` with the same ``given``, for counted pairs."""
    totals = pairs.groupBy(given).agg(F.sum("n").alias("_total"))
    return pairs.join(totals, given).withColumn(name, F.col("n") / F.col("_total")).drop("_total")


def env_field_usage(events: DataFrame, hours: int, as_of, size: int | None = None) -> DataFrame:
    """Environment variables used lately with their events: all of them, or the ``size`` most used."""
    recent = filter_time_range(events, hours, as_of)
    used = (
        recent.select(F.explode(F.map_keys("env")).alias("key")).groupBy("key").agg(count_rows().alias("n_events"))
    )
    return used if size is None else used.orderBy(F.desc("n_events"), "key").limit(size)


def config_version_counts(events: DataFrame, as_of, days: int = 7, size: int = 10) -> DataFrame:
    recent = filter_time_range(events, days * 24, as_of).where(F.col("config_version").isNotNull())
    return (
        recent.groupBy("config_version")
        .agg(count_rows().alias("n_events"))
        .orderBy(F.desc("n_events"), "config_version")
        .limit(size)
    )


def hashed_event_count(events: DataFrame, as_of, days: int = 7) -> DataFrame:
    return filter_time_range(events, days * 24, as_of).agg(F.count_if(has_hashed_env()).alias("n_events"))


def ingest_count(events: DataFrame) -> DataFrame:
    return events.agg(count_rows().alias("n_events"))

"""Selections over the log: directory, outcome, time, environment, text, subscriptions, display rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelltrail.functions.policy import is_hashed
from shelltrail.functions.text import search_terms, shorten, shorten_path
from shelltrail.functions.times import duration_ms, hours_before, moment, time_ago, wire_time
from shelltrail.sources.history import DAY


def filter_by_directory(events: DataFrame, pwd: str) -> DataFrame:
    return events.where(F.col("pwd") == pwd)


def successful_commands(events: DataFrame) -> DataFrame:
    return events.where(F.col("return_code") == 0)


def failed_commands(events: DataFrame) -> DataFrame:
    """Everything that did not succeed; an event without a return code counts as failed."""
    return events.where(~F.col("return_code").eqNullSafe(0))


def filter_time_range(events: DataFrame, hours: int, as_of, until=None) -> DataFrame:
    """The last ``hours``; on a dated history only those days are read."""
    since = hours_before(as_of, hours)
    kept = events.where(F.col("start_timestamp") >= since)
    if until is not None:
        kept = kept.where(F.col("start_timestamp") <= moment(until))
    if DAY in events.columns:
        kept = kept.where(F.col(DAY) >= F.to_date(since))
        if until is not None:
            kept = kept.where(F.col(DAY) <= F.to_date(moment(until)))
    return kept


def filter_env_equals(events: DataFrame, key: str, value: str) -> DataFrame:
    """By the variable's own column where the history has one, else inside the map."""
    own = f"env_{key}"
    return events.where((F.col(own) if own in events.columns else F.col("env")[key]) == value)


def filter_env_exists(events: DataFrame, key: str) -> DataFrame:
    own = f"env_{key}"
    if own in events.columns:
        return events.where(F.col(own).isNotNull())
    return events.where(F.map_contains_key("env", key))


def has_hashed_env() -> Column:
    return F.exists(F.map_values("env"), is_hashed)


def events_with_hashed_env(events: DataFrame) -> DataFrame:
    return events.where(has_hashed_env())


def search_command_prefix(events: DataFrame, prefix: str, column: str = "command") -> DataFrame:
    """Events with a word in the command that starts with ``prefix``, in any case."""
    wanted = prefix.lower()
    return events.where(F.exists(search_terms(F.col(column)), lambda term: term.startswith(wanted)))


def search_command_match(events: DataFrame, text: str, column: str = "command") -> DataFrame:
    """Events that share a word with the query text."""
    return events.where(F.arrays_overlap(search_terms(F.col(column)), search_terms(F.lit(text))))


def parse_subscription(filter_text: str) -> dict[str, str]:
    """``k=v,k2=v2``; items without ``=`` are ignored and the last of equal keys counts."""
    pairs = (item.split("=", 1) for item in filter_text.split(","))
    return {pair[0].strip(): pair[1].strip() for pair in pairs if len(pair) == 2}


# Names on the wire that are called differently in the event table.
WIRE_NAMES = {"@timestamp": "ingest_timestamp", "_config_version": "config_version"}
WIRE_TIMES = {"start_timestamp", "end_timestamp", "ingest_timestamp"}


def as_on_wire(name: str) -> Column:
    column = F.col(name)
    return wire_time(column) if name in WIRE_TIMES else column.cast("string")


def subscription_predicate(columns: list[str], wanted: dict[str, str]) -> Column:
    """All pairs must equal the printed top-level field. A field that is missing never matches."""
    matches = F.lit(True)
    for key, value in wanted.items():
        name = WIRE_NAMES.get(key, key)
        known = name in columns and name not in ("env", "event_id")
        matches = matches & (F.coalesce(as_on_wire(name) == value, F.lit(False)) if known else F.lit(False))
    return matches


def filter_subscription(events: DataFrame, filter_text: str) -> DataFrame:
    """For a table or a stream. An empty filter lets everything through."""
    return events.where(subscription_predicate(events.columns, parse_subscription(filter_text)))


def project_source(events: DataFrame, fields: list[str]) -> DataFrame:
    """Only the named fields, ``env.KEY`` included; the scan reads no other column."""
    picked = []
    for name in fields:
        if name.startswith("env."):
            picked.append(F.col("env")[name[4:]].alias(name.replace(".", "_")))
        else:
            picked.append(F.col(name))
    return events.select(*picked)


def status() -> Column:
    return F.when(F.col("return_code") != 0, "fail").otherwise("ok")


def history_report(events: DataFrame, pwd: str, hours: int, limit: int, as_of) -> DataFrame:
    """The latest commands of a directory."""
    recent = filter_time_range(filter_by_directory(events, pwd), hours, as_of)
    latest = recent.orderBy(F.desc("start_timestamp"), F.desc("event_id")).limit(limit)
    return latest.select(
        "event_id",
        status().alias("status"),
        "command",
        F.date_format("start_timestamp", "HH:mm:ss").alias("started"),
        duration_ms().alias("duration_ms"),
    )


def live_view_rows(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        status().alias("status"),
        shorten(F.col("command"), 50, 47).alias("command"),
        shorten_path(F.col("pwd")).alias("pwd"),
        ((F.unix_micros("end_timestamp") - F.unix_micros("start_timestamp")) / 1000.0).alias("duration_ms"),
    )


def suggestion_rows(suggestions: DataFrame, as_of) -> DataFrame:
    """Suggestions as they are shown: a shortened command and how long ago it ran."""
    return suggestions.select(
        shorten(F.col("command"), 60, 57).alias("command"),
        F.round("score", 1).alias("score"),
        "frequency",
        time_ago(F.col("last_used"), as_of).alias("used"),
        "context",
    )

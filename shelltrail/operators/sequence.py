"""Commands in order: what came before, what comes next, and how often."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelltrail.functions.text import basename, command_name, is_blank, shell_words
from shelltrail.operators.usage import count_rows, share_within, time_unit
from shelltrail.plans.ordered import DEFAULT_CUTS, Cuts, with_neighbour
from shelltrail.plans.top import first_per_key
from shelltrail.schema import ACTOR, event_time, with_user

BY = list(ACTOR)


def parse_commands(rows: DataFrame, column: str = "command") -> DataFrame:
    """Adds ``command_name``, ``args`` and ``num_args``."""
    with_words = rows.withColumn("_words", shell_words(F.col(column)))
    return with_words.withColumns(
        {
            "command_name": F.when(F.size("_words") > 0, F.col("_words")[0]).otherwise(""),
            "args": F.slice("_words", 2, F.greatest(F.size("_words"), F.lit(1))),
            "num_args": F.greatest(F.size("_words") - 1, F.lit(0)),
        }
    ).drop("_words")


def _timed(events: DataFrame, by: list[str]) -> DataFrame:
    source = with_user(events) if "user" in by else events
    return source.where(F.col("command").isNotNull()).withColumn("_at", event_time())


def previous_command(events: DataFrame, by: list[str] = BY, cuts: Cuts = DEFAULT_CUTS) -> DataFrame:
    """Adds ``previous_cmd`` in time order, empty at the start of a history.

    A blank command is no row of the result, but the row after it has the blank
    text before it. Events without a command are not there at all.
    """
    linked = with_neighbour(
        _timed(events, by), by, "_at", "event_id", {"previous_cmd": F.col("command")}, cuts=cuts
    )
    return (
        linked.where(~is_blank(F.col("command")))
        .withColumn("previous_cmd", F.coalesce("previous_cmd", F.lit("")))
        .drop("_at")
    )


def next_command(events: DataFrame, by: list[str] = BY, cuts: Cuts = DEFAULT_CUTS) -> DataFrame:
    """Adds ``next_cmd``, the next command that is not blank; the last row of a history has none and is left out."""
    kept = _timed(events, by).where(~is_blank(F.col("command")))
    linked = with_neighbour(kept, by, "_at", "event_id", {"next_cmd": F.col("command")}, ahead=True, cuts=cuts)
    return linked.where(F.col("next_cmd").isNotNull()).drop("_at")


def newest_first() -> list[Column]:
    return [event_time().desc(), F.desc("event_id")]


def recent_commands(events: DataFrame, n: int = 20, pwd: str | None = None) -> DataFrame:
    """The last ``n`` successful events of a directory, or of every directory, in time order.

    Events without a command take one of the ``n`` places and are then left out.
    """
    good = events.where(F.col("return_code") == 0)
    if pwd is not None:
        latest = good.where(F.col("pwd") == pwd).orderBy(*newest_first()).limit(n)
        return latest.where(F.col("command").isNotNull()).orderBy(event_time(), "event_id")
    latest = first_per_key(good, ["pwd"], newest_first(), n, "event_id")
    return latest.where(F.col("command").isNotNull())


def last_n_events(events: DataFrame, n: int = 20, by: list[str] = BY) -> DataFrame:
    order = [F.desc("start_timestamp"), F.desc("event_id")]
    return first_per_key(with_user(events), by, order, n, "event_id")


def latest_directory(events: DataFrame, by: list[str] = BY) -> DataFrame:
    """The newest ``env.PWD`` per key; events without one are ignored."""
    known = with_user(events).withColumn("_pwd", F.col("env")["PWD"]).where(F.col("_pwd") != "")
    newest = F.max(F.struct("start_timestamp", "event_id", F.col("_pwd").alias("pwd")))
    return known.groupBy(*by).agg(newest.alias("_newest")).select(*by, "_newest.pwd", "_newest.start_timestamp")


def history_order(events: DataFrame, by: list[str] = BY, ascending: bool = True) -> DataFrame:
    """Whole histories in time order: one sorted run per key, spread over the cluster by range."""
    at = event_time()
    order = [at.asc(), F.asc("event_id")] if ascending else [at.desc(), F.desc("event_id")]
    return with_user(events).orderBy(*by, *order)


def scan_cap(events: DataFrame, max_commands: int | None = None) -> DataFrame:
    """The successful history in time order, the first ``max_commands`` where a cap is wanted."""
    good = events.where(F.col("return_code") == 0)
    if max_commands is None:
        return good
    return good.orderBy(event_time(), "event_id").limit(max_commands)


def _cwd(cwd_key: str) -> Column:
    return F.coalesce(basename(F.col("env")[cwd_key]), F.lit(""))


def command_records(
    events: DataFrame, by: list[str] = BY, cwd_key: str = "OLDPWD", as_of=None, cuts: Cuts = DEFAULT_CUTS
) -> DataFrame:
    """One feature row per command: name, arguments, hour, weekday, predecessor, directory, outcome.

    A command whose time is unreadable has the hour and weekday of ``as_of``.
    """
    rows = parse_commands(previous_command(events, by, cuts))
    return rows.select(
        "event_id",
        "command",
        "command_name",
        "num_args",
        time_unit("hour", as_of).alias("hour"),
        time_unit("weekday", as_of).alias("weekday"),
        "previous_cmd",
        _cwd(cwd_key).alias("cwd"),
        F.coalesce("return_code", F.lit(0)).alias("return_code"),
    )


def transition_counts(events: DataFrame, by: list[str] = BY, cuts: Cuts = DEFAULT_CUTS) -> DataFrame:
    """How often one command name followed another, over successful commands."""
    good = events.where(F.col("return_code") == 0)
    narrow = with_user(good).select(
        *by, "event_id", "command", "ingest_timestamp", "end_timestamp"
    )
    # Only names travel through the shuffle. An empty command hands on nothing.
    timed = _timed(narrow, by).select(
        *by, "event_id", "_at", command_name(F.col("command")).alias("name"), (F.col("command") != "").alias("given")
    )
    handed_on = F.when(F.col("given"), F.col("name"))
    linked = with_neighbour(timed, by, "_at", "event_id", {"previous": handed_on}, cuts=cuts)
    pairs = linked.where((F.col("name") != "") & F.col("previous").isNotNull())
    return pairs.groupBy(F.col("previous").alias("prev_name"), F.col("name").alias("next_name")).agg(
        count_rows().alias("n")
    )


def transition_probabilities(events: DataFrame, by: list[str] = BY, cuts: Cuts = DEFAULT_CUTS) -> DataFrame:
    return share_within(transition_counts(events, by, cuts), "prev_name")


def markov_next_command(events: DataFrame, k: int = 5, by: list[str] = BY, cuts: Cuts = DEFAULT_CUTS) -> DataFrame:
    """The ``k`` most likely next names after every name."""
    order = [F.desc("n"), F.asc("next_name")]
    return first_per_key(
        transition_probabilities(events, by, cuts), ["prev_name"], order, k, "next_name", rank="rank"
    )


def directory_command_probabilities(events: DataFrame, cwd_key: str = "OLDPWD") -> DataFrame:
    """How likely each command name is in a directory, by the directory's own name."""
    good = events.where((F.col("return_code") == 0) & F.col("command").isNotNull() & ~is_blank(F.col("command")))
    named = good.select(_cwd(cwd_key).alias("cwd"), command_name(F.col("command")).alias("command_name"))
    pairs = named.where(F.col("cwd") != "").groupBy("cwd", "command_name").agg(count_rows().alias("n"))
    return share_within(pairs, "cwd")

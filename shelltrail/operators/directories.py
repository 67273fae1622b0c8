"""Directories ranked by how recently and how often they were used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelltrail.functions.text import path_label, search_terms
from shelltrail.functions.times import age_hours, hours_before, moment
from shelltrail.plans.top import first_per_key
from shelltrail.schema import with_user

EVIDENCE = ["path", "seen", "assumed"]


def _newest(events: DataFrame, by: list[str], n: int | None) -> DataFrame:
    if n is None:
        return events
    order = [F.desc("start_timestamp"), F.desc("event_id")]
    if by:
        return first_per_key(events, by, order, n, "event_id")
    return events.orderBy(*order).limit(n)


def cd_target(command: Column, pwd: Column, home: Column) -> Column:
    """The directory a ``cd`` command names: unquoted, ``~`` and relative paths resolved where they can be."""
    named = F.btrim(F.get(F.split(command, " ", 2), F.lit(1)), F.lit("\"' "))
    return (
        F.when(named.startswith("~"), F.concat(F.coalesce(home, F.lit("~")), named.substr(F.lit(2), F.length(named))))
        .when(~named.startswith("/") & (F.coalesce(pwd, F.lit("")) != ""), F.concat(pwd, F.lit("/"), named))
        .otherwise(named)
    )


def existing_directories(dirs: DataFrame, inventory: DataFrame | None) -> DataFrame:
    """Keeps directories that are in the inventory (path, or hostname and path); without one, all of them."""
    if inventory is None:
        return dirs
    on = [name for name in ("hostname", "path") if name in inventory.columns and name in dirs.columns]
    return dirs.join(inventory, on, "left_semi")


def cd_evidence(events: DataFrame, by: list[str], cap: int | None, home: str | None) -> DataFrame:
    """Targets among the latest ``cap`` events with a word starting with ``cd``; the cap comes before the check for a real ``cd``."""
    candidates = events.where(F.exists(search_terms(F.col("command")), lambda term: term.startswith("cd")))
    latest = _newest(candidates, by, cap).where(F.col("command").startswith("cd "))
    own_home = F.lit(home) if home is not None else F.col("env")["HOME"]
    target = cd_target(F.col("command"), F.col("env")["PWD"], own_home)
    return _evidence(latest, by, target)


def pwd_evidence(events: DataFrame, by: list[str], cap: int | None) -> DataFrame:
    """Working directories of the latest ``cap`` events."""
    latest = _newest(events, by, cap)
    return _evidence(latest, by, F.col("env")["PWD"]).where(F.coalesce(F.col("path"), F.lit("")) != "")


def _evidence(rows: DataFrame, by: list[str], path: Column) -> DataFrame:
    host = [] if "hostname" in by else ["hostname"]
    return rows.select(
        *by,
        *host,
        path.alias("path"),
        F.col("start_timestamp").alias("seen"),
        F.lit(None).cast("timestamp").alias("assumed"),
    )


def current_evidence(current: DataFrame, by: list[str], as_of) -> DataFrame:
    """The current directory ``cwd`` and its ancestors below the root; farther ancestors are assumed older."""
    unseen = F.lit(None).cast("timestamp")
    itself = current.select(
        *by, F.col("cwd").alias("path"), unseen.alias("seen"), moment(as_of).alias("assumed")
    )
    split = current.withColumn("_parts", F.split("cwd", "/")).withColumn("_n", F.size("_parts"))
    each = split.select(*by, "cwd", "_parts", "_n", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i"))
    # Positions count from the empty part before the first slash.
    above = F.array_join(F.filter(F.slice("_parts", F.lit(1), F.col("_i")), lambda part: part != ""), "/")
    ancestors = each.where(F.element_at("_parts", F.col("_i")) != "").select(
        *by,
        "cwd",
        F.concat(F.lit("/"), above).alias("path"),
        unseen.alias("seen"),
        (moment(as_of) - F.make_dt_interval(F.lit(0), F.col("_n") - F.col("_i") + 1)).alias("assumed"),
    )
    return itself.unionByName(ancestors.where(F.col("path") != F.col("cwd")).drop("cwd"))


def directory_usage(evidence: DataFrame, by: list[str], as_of) -> DataFrame:
    """Frequency and last use; a directory that was never seen has its assumed time, else a day ago."""
    return evidence.groupBy(*by, "path").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.coalesce(F.max("seen"), F.max("assumed"), hours_before(as_of, 24)).alias("last_used"),
    )


def frecency(frequency: Column, last_used: Column, as_of) -> Column:
    return 0.7 * (100.0 / (1.0 + age_hours(last_used, as_of) / 24.0)) + 0.3 * frequency


def rank_directories(
    events: DataFrame,
    as_of,
    cwd: str | DataFrame | None = None,
    home: str | None = None,
    inventory: DataFrame | None = None,
    cap_cd: int | None = None,
    cap_pwd: int | None = None,
    limit: int = 10,
    by: list[str] | None = None,
) -> DataFrame:
    """The best ``limit`` directories, of one person or (with ``by``) of every key.

    ``cwd`` is the current directory, or a table of ``by`` and ``cwd``. All evidence
    counts; the caps keep the newest rows of either kind only.
    """
    by = list(by or [])
    source = with_user(events) if "user" in by else events
    used = cd_evidence(source, by, cap_cd, home).unionByName(pwd_evidence(source, by, cap_pwd))
    evidence = existing_directories(used, inventory).select(*by, *EVIDENCE)
    if cwd is not None:
        current = cwd if isinstance(cwd, DataFrame) else events.sparkSession.range(1).select(F.lit(cwd).alias("cwd"))
        evidence = evidence.unionByName(current_evidence(current, by, as_of))
    scored = directory_usage(evidence, by, as_of).withColumn(
        "score", frecency(F.col("frequency"), F.col("last_used"), as_of)
    )
    labelled = scored.withColumn("label", path_label(F.col("path")))
    order = [F.desc("score"), F.asc("path")]
    if by:
        return first_per_key(labelled, by, order, limit, "path", rank="place")
    return labelled.orderBy(*order).limit(limit)

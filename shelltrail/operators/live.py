"""Suggestions from the last few events of a person."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelltrail.schema import ACTOR

# What is suggested in a repository and in a source tree.
GIT_SUGGESTIONS = ["git status", "git log --oneline -10"]
SOURCE_SUGGESTIONS = ["ls -la", "find . -name '*.go' -o -name '*.py' -o -name '*.js'"]


def live_suggestions(window: DataFrame, by: list[str] = list(ACTOR), at_least: int = 5, most: int = 3) -> DataFrame:
    """``window`` holds the last events per key. Keys with fewer than ``at_least`` events get nothing."""
    git = (F.col("return_code") == 0) & F.col("command").contains("git")
    per_directory = window.groupBy(*by, "pwd").agg(
        F.max(F.struct("start_timestamp", "event_id")).alias("_last"),
        F.bool_or(git).alias("_git"),
        F.count(F.lit(1)).alias("_n"),
    )
    current = (
        per_directory.groupBy(*by)
        .agg(F.max(F.struct("_last", "pwd", "_git")).alias("_newest"), F.sum("_n").alias("n_events"))
        .where(F.col("n_events") >= at_least)
        .select(*by, F.col("_newest.pwd").alias("cwd"), F.col("_newest._git").alias("_git"))
    )
    none = F.array().cast("array<string>")
    in_source = F.col("cwd").contains("src") | F.col("cwd").contains("code")
    offered = F.concat(
        F.when(F.col("_git"), F.array(*map(F.lit, GIT_SUGGESTIONS))).otherwise(none),
        F.when(in_source, F.array(*map(F.lit, SOURCE_SUGGESTIONS))).otherwise(none),
    )
    first = current.select(*by, "cwd", F.slice(offered, 1, most).alias("_offered"))
    return first.select(*by, "cwd", F.posexplode("_offered").alias("place", "suggestion")).withColumn(
        "place", F.col("place") + 1
    )

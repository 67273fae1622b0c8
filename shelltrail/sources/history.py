"""The durable history: Parquet, one folder per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from shelltrail.functions.policy import EnvPolicy
from shelltrail.session import Folder, prepare, scratch_path
from shelltrail.sources.events import line_status

DAY = "event_date"


def with_day(events: DataFrame) -> DataFrame:
    return events.withColumn(DAY, F.to_date("start_timestamp"))


def write_history(
    events: DataFrame, path: str, mode: str = "append", promote: tuple[str, ...] = (), only_days: bool = False
) -> None:
    """Files are balanced per day: small days share a task, a large day is split over several.

    Rows are sorted by directory inside a file, so that a directory's history
    is found by the file statistics. Variables in ``promote`` get a column of
    their own (``env_NAME``), on which filters reach the scan. With ``only_days``
    an overwrite replaces the days that the events have, and no others.
    """
    dated = with_day(events).withColumns({f"env_{name}": F.col("env")[name] for name in promote})
    writer = dated.hint("rebalance", DAY).sortWithinPartitions(DAY, "pwd").write.mode(mode).partitionBy(DAY)
    writer.option("partitionOverwriteMode", "dynamic" if only_days else "static").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return prepare(spark).read.parquet(path)


def compact_days(spark: SparkSession, streamed: str, path: str, before: str, promote: tuple[str, ...] = ()) -> list:
    """Moves the days before ``before`` from a streamed archive (a folder per day and micro-batch) into the history.

    What the history holds of those days, from an earlier run or for late events, is merged by event id, so a run that
    broke off is simply run again. Only the micro-batches that were read leave the archive: what a stream writes beside
    this run stays for the next. Returns the days; the driver sees them and the numbers of their micro-batches.
    """
    old = prepare(spark).read.option("basePath", streamed).parquet(streamed).where(F.col(DAY) < F.lit(before).cast("date"))
    # The files were listed once, so these are the folders that all reads of `old` see.
    read = [tuple(row) for row in old.select(DAY, "batch").distinct().collect()]
    days = sorted({day for day, _ in read})
    if not days:
        return []
    events = old.drop("batch", DAY)
    if any(name.startswith(DAY) for name in Folder(spark, path).names()):
        kept = read_history(spark, path).where(F.col(DAY).isin(*days))
        events = events.unionByName(kept.select(*events.columns))
    staged = scratch_path(spark, "compact")
    once = events.groupBy("event_id").agg(F.any_value(F.struct(*events.columns)).alias("_e")).select("_e.*")
    try:
        once.write.parquet(staged)
        dated = spark.read.parquet(staged)
        write_history(dated, path, "overwrite", promote, only_days=True)
    finally:
        Folder(spark, staged).delete()
    for day, batch in read:
        Folder(spark, f"{streamed}/{DAY}={day}/batch={batch}").delete()
    return days


def rewrite_history(events: DataFrame, policy: EnvPolicy, out: str | None = None) -> DataFrame:
    """Old events under the current policy; values that are hashed already stay as they are.

    With ``out`` they are written to that new place, never over their source.
    """
    masked = events.drop(DAY).withColumns(
        {
            "env": policy.masked(F.col("env"), keep_hashed=True),
            "config_version": F.lit(policy.version),
        }
    )
    if out:
        write_history(masked, out, mode="errorifexists")
    return masked


def counters() -> list[Column]:
    status = line_status()
    return [
        F.count_if(status != "blank").alias("received"),
        F.count_if(status == "valid").alias("sent"),
        F.count_if(status == "invalid").alias("errors"),
    ]


def ingest_metrics(lines: DataFrame) -> DataFrame:
    """Counters over raw lines in one pass: received, sent, errors."""
    return lines.agg(*counters())


def observe_ingest(lines: DataFrame, name: str = "ingest") -> tuple[DataFrame, Observation]:
    """The lines unchanged, counted while whatever job reads them runs."""
    observation = Observation(name)
    return lines.observe(observation, *counters()), observation

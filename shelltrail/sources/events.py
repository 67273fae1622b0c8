"""Command events from newline-delimited JSON or Parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelltrail.functions.wire import address_or_null, is_json_object, time_or_null
from shelltrail.plans.once import worked_out
from shelltrail.schema import EVENT_SCHEMA, WIRE_SCHEMA, derived_event_id
from shelltrail.session import prepare


def from_wire(rows: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Wire columns (all text) to typed events; a malformed value becomes null, the row stays."""
    typed = rows.select(
        *carried,
        "command",
        F.col("return_code").try_cast("int").alias("return_code"),
        time_or_null(F.col("start_timestamp")).alias("start_timestamp"),
        time_or_null(F.col("end_timestamp")).alias("end_timestamp"),
        time_or_null(F.col("@timestamp")).alias("ingest_timestamp"),
        "pwd",
        "hostname",
        address_or_null(F.col("ip_address")).alias("ip_address"),
        "env",
        F.col("_config_version").alias("config_version"),
    )
    return typed if "event_id" in carried else typed.withColumn("event_id", derived_event_id())


def read_events(spark: SparkSession, paths: str | list[str], format: str = "json") -> DataFrame:
    """Several paths, or patterns, are read as one log. Unknown fields are ignored, malformed ones nulled, and a line
    that is not a JSON object is no event."""
    reader = prepare(spark).read
    paths = [paths] if isinstance(paths, str) else list(paths)
    if format == "parquet":
        return reader.parquet(*paths)
    good, _ = split_valid_invalid(reader.text(paths))
    return parse_lines(good)


def union_logs(logs: list[DataFrame]) -> DataFrame:
    """Logs of different ages as one: columns that a log lacks are null."""
    return reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), logs)


def stream_events(spark: SparkSession, path: str, format: str = "json", max_files: int | None = None) -> DataFrame:
    """The same events as they arrive in a folder."""
    reader = prepare(spark).readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if format == "parquet":
        return reader.schema(EVENT_SCHEMA).parquet(path)
    good, _ = split_valid_invalid(reader.text(path))
    return parse_lines(good)


def parse_lines(lines: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Valid JSON lines in ``value`` (from files or a message bus) to events."""
    parsed = lines.select(*carried, F.from_json("value", WIRE_SCHEMA).alias("_event"))
    return from_wire(parsed.select(*carried, "_event.*"), carried)


def line_status() -> Column:
    line = F.regexp_replace("value", r"\r\z", "")
    return (
        F.when(F.col("value").isNull() | (line == ""), "blank")
        .when(is_json_object(line), "valid")
        .otherwise("invalid")
    )


def split_valid_invalid(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that are a JSON object, unchanged, and the others; blank lines are in neither."""
    judged = worked_out(lines, {"_status": line_status()})
    return (
        judged.where(F.col("_status") == "valid").drop("_status"),
        judged.where(F.col("_status") == "invalid").drop("_status"),
    )

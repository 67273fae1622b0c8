"""Backfill from raw capture logs: decode, apply the policy, assemble events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelltrail.functions.policy import EnvPolicy, env_from_entries, without_capture_noise
from shelltrail.functions.times import moment
from shelltrail.functions.wire import address_or_null, decode_base64, is_json_object, strict_time
from shelltrail.plans.once import worked_out
from shelltrail.schema import CAPTURE_SCHEMA, derived_event_id

# White space as the hooks trim it around a command.
TRIMMED = r"\t-\r\x20\x85\p{Z}"


def decode_captures(raw: DataFrame, policy: EnvPolicy) -> tuple[DataFrame, DataFrame]:
    """``capture`` (base64 of JSON) to command, pwd, start and masked environment.

    Returns the decoded rows and the rejected ones; other columns pass through.
    """
    text = worked_out(raw, {"_text": decode_base64(F.col("capture"))})
    read = worked_out(
        text, {"_object": is_json_object(F.col("_text")), "_record": F.from_json("_text", CAPTURE_SCHEMA)}
    )
    start = F.col("_record.start_timestamp")
    judged = read.withColumn("_start", strict_time(start)).withColumn(
        "_valid", F.col("_object") & (start.isNull() | F.col("_start").isNotNull())
    )
    passed = [name for name in raw.columns if name != "capture"]
    good = judged.where("_valid").select(
        *passed,
        F.col("_record.command").alias("command"),
        F.col("_record.pwd").alias("pwd"),
        F.col("_start").alias("start_timestamp"),
        policy.masked(env_from_entries(without_capture_noise(F.col("_record.environment")))).alias("env"),
    )
    return good, judged.where(~F.col("_valid")).select(*raw.columns)


def decode_env_blobs(raw: DataFrame, policy: EnvPolicy) -> tuple[DataFrame, DataFrame]:
    """The legacy ``blob``: base64 of ``K=V`` lines. An empty blob is an empty environment."""
    read = worked_out(raw, {"_text": decode_base64(F.col("blob"))})
    passed = [name for name in raw.columns if name != "blob"]
    env = env_from_entries(F.split("_text", "\n"))
    good = read.where(F.col("_text").isNotNull()).select(*passed, policy.masked(env).alias("env"))
    return good, read.where(F.col("_text").isNull()).select(*raw.columns)


def assemble_events(decoded: DataFrame, received, policy: EnvPolicy | None = None) -> tuple[DataFrame, DataFrame]:
    """Decoded captures with their finishing arguments (all text) to events.

    A return code that is not a whole number and an end time that is not a time
    reject the row. Without an end time the command ended when it was ``received``.
    """
    given = F.coalesce(F.col("end_timestamp"), F.lit(""))
    # Whatever stands between date and time, the blank of older hooks included, is read as T.
    written = F.concat(F.substring(given, 1, 10), F.lit("T"), given.substr(F.lit(12), F.length(given)))
    end = F.when(given == "", moment(received)).otherwise(strict_time(written))
    code = F.when(F.col("return_code").rlike(r"\A[+-]?\d+\z"), F.col("return_code").try_cast("int"))
    judged = decoded.withColumns({"_code": code, "_end": end})
    valid = F.col("_code").isNotNull() & F.col("_end").isNotNull()
    command = F.regexp_replace(F.regexp_replace("command", rf"\A[{TRIMMED}]+", ""), rf"(?<![{TRIMMED}])[{TRIMMED}]+\z", "")
    events = judged.where(valid).select(
        *(["event_id"] if "event_id" in decoded.columns else []),
        command.alias("command"),
        F.col("_code").alias("return_code"),
        "start_timestamp",
        F.col("_end").alias("end_timestamp"),
        F.lit(None).cast("timestamp").alias("ingest_timestamp"),
        "pwd",
        F.coalesce("hostname", F.lit("unknown")).alias("hostname"),
        address_or_null(F.col("ip_address")).alias("ip_address"),
        F.when(F.size("env") > 0, F.col("env")).alias("env"),
        F.lit(policy.version if policy else None).cast("string").alias("config_version"),
    )
    if "event_id" not in decoded.columns:
        events = events.withColumn("event_id", derived_event_id())
    return events, judged.where(~valid).select(*decoded.columns)

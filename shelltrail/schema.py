"""The command event and its raw forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

EVENT_COLUMNS = [
    ("event_id", T.LongType()),
    ("command", T.StringType()),
    ("return_code", T.IntegerType()),
    ("start_timestamp", T.TimestampType()),
    ("end_timestamp", T.TimestampType()),
    ("ingest_timestamp", T.TimestampType()),
    ("pwd", T.StringType()),
    ("hostname", T.StringType()),
    ("ip_address", T.StringType()),
    ("env", T.MapType(T.StringType(), T.StringType())),
    ("config_version", T.StringType()),
]

EVENT_SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in EVENT_COLUMNS])

# One event as it travels: every scalar is read as text, so that one malformed
# field becomes null instead of costing the whole row.
WIRE_SCHEMA = T.StructType(
    [
        T.StructField("command", T.StringType()),
        T.StructField("return_code", T.StringType()),
        T.StructField("start_timestamp", T.StringType()),
        T.StructField("end_timestamp", T.StringType()),
        T.StructField("@timestamp", T.StringType()),
        T.StructField("pwd", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("env", T.MapType(T.StringType(), T.StringType())),
        T.StructField("_config_version", T.StringType()),
    ]
)

# What the pre-exec hook encodes: the environment is a list of K=V entries.
CAPTURE_SCHEMA = T.StructType(
    [
        T.StructField("command", T.StringType()),
        T.StructField("pwd", T.StringType()),
        T.StructField("start_timestamp", T.StringType()),
        T.StructField("environment", T.ArrayType(T.StringType())),
    ]
)

# The keys that order one person's history. A fleet holds many histories.
ACTOR = ("hostname", "user")


def event_time() -> Column:
    """The arrival time where the shipper recorded one, else the end of the command."""
    return F.coalesce(F.col("ingest_timestamp"), F.col("end_timestamp"))


def derived_event_id() -> Column:
    """A stable id for events that come without one, used to break ties in time."""
    return F.xxhash64("hostname", "start_timestamp", "end_timestamp", "pwd", "command")


def with_user(events: DataFrame) -> DataFrame:
    """Adds ``user`` from the recorded environment, where the column is not there yet."""
    if "user" in events.columns:
        return events
    return events.withColumn("user", F.col("env")["USER"])

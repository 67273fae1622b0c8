"""The sample ``events`` table read as command events.

The sample tables know users, event types and a number ``k`` between 0 and 99;
fixed rules turn each row into a command with a directory, an outcome and an
environment, so that every operator runs on the whole table at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelltrail.functions.times import wire_time
from shelltrail.plans.ordered import with_neighbour
from shelltrail.session import prepare

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def as_commands(events: DataFrame) -> DataFrame:
    """Narrow, row by row; works on a stream as well."""
    base = events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("start_timestamp"),
        "user_id",
        "event_type",
        F.round("value").cast("long").alias("duration"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    k, kind = F.col("k"), F.col("event_type")
    number = lambda divisor: (k % divisor).cast("string")
    signup = F.array(F.lit("cd ~/src"), F.lit("cd api"), F.lit('cd "/var/log"'), F.lit("cdrecord x"))
    folder = F.array(*map(F.lit, ["/src/api", "/src/web", "/notes", "/code"]))
    command = (
        F.when(kind == "click", F.concat(F.lit('git commit -m "fix '), number(10), F.lit('"')))
        .when(kind == "view", F.when(k % 2 == 0, "ls -la").otherwise("git status"))
        .when(kind == "purchase", F.concat(F.lit("docker run --rm app:"), number(5)))
        .when(kind == "signup", signup[k % 4])
        .when(kind == "error", F.concat(F.lit("kubectl get pods -n ns"), number(3)))
    )
    home = F.concat(F.lit("/home/u"), F.col("user_id").cast("string"))
    return base.select(
        "event_id",
        command.alias("command"),
        F.when((kind == "error") & (k % 2 == 0), 1).otherwise(0).alias("return_code"),
        "start_timestamp",
        (F.timestamp_micros(F.unix_micros("start_timestamp") + F.col("duration") * 1000)).alias("end_timestamp"),
        F.lit(None).cast("timestamp").alias("ingest_timestamp"),
        F.concat(home, folder[k % 4]).alias("pwd"),
        F.concat(F.lit("host-"), (F.col("user_id") % 7).cast("string")).alias("hostname"),
        F.lit(None).cast("string").alias("ip_address"),
        F.when(k < 80, "1.0.0").otherwise("1.0.1").alias("config_version"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"),
        home.alias("home"),
        "k",
    )


def _environment(k: Column, oldpwd: Column | None = None) -> Column:
    stage = F.array(F.lit("production"), F.lit("staging"), F.lit("development"))[k % 3]
    pairs = [
        (F.lit("PWD"), F.col("pwd")),
        (F.lit("HOME"), F.col("home")),
        (F.lit("USER"), F.col("user")),
        (F.lit("SHELL"), F.lit("/bin/bash")),
        (F.lit("TERM"), F.lit("xterm")),
        (F.lit("ENVIRONMENT"), stage),
        (F.lit("NODE_ENV"), stage),
        (F.lit("API_KEY"), F.concat(F.lit("secret"), k.cast("string"))),
        (F.lit("DATABASE_URL"), F.concat(F.lit("https://db"), (k % 5).cast("string"), F.lit(".example.com/x"))),
    ]
    env = F.create_map(*[part for pair in pairs for part in pair])
    if oldpwd is None:
        return env
    return F.when(oldpwd.isNull(), env).otherwise(F.map_concat(env, F.create_map(F.lit("OLDPWD"), oldpwd)))


COLUMNS = [
    "event_id", "command", "return_code", "start_timestamp", "end_timestamp", "ingest_timestamp",
    "pwd", "hostname", "ip_address", "env", "config_version",
]


def command_events(spark: SparkSession, sf_dir: str, oldpwd: bool = False) -> DataFrame:
    """The whole table; ``OLDPWD`` (the user's previous directory) costs a shuffle and is only added on request."""
    rows = as_commands(table(spark, sf_dir, "events"))
    if oldpwd:
        rows = with_neighbour(rows, ["user"], "start_timestamp", "event_id", {"_oldpwd": F.col("pwd")})
        return rows.withColumn("env", _environment(F.col("k"), F.col("_oldpwd"))).select(*COLUMNS)
    return rows.withColumn("env", _environment(F.col("k"))).select(*COLUMNS)


def stream_of_commands(stream: DataFrame) -> DataFrame:
    return as_commands(stream).withColumn("env", _environment(F.col("k"))).select(*COLUMNS)


def wire_struct() -> Column:
    """A command event as the JSON object that travels."""
    return F.struct(
        "command",
        "return_code",
        wire_time(F.col("start_timestamp")).alias("start_timestamp"),
        wire_time(F.col("end_timestamp")).alias("end_timestamp"),
        "pwd",
        "hostname",
        "env",
        F.col("config_version").alias("_config_version"),
    )


def _env_entries() -> Column:
    return F.transform(
        F.map_entries("env"), lambda entry: F.concat(entry["key"], F.lit("="), entry["value"])
    )


def wire_lines(events: DataFrame) -> DataFrame:
    """NDJSON lines, some of them damaged by a fixed rule on ``event_id``:
    of every ten, one is cut in half, one wrapped in a list, one blank and one has a text for its return code."""
    line = F.to_json(wire_struct())
    turn = F.col("event_id") % 10
    damaged = (
        F.when(turn == 7, F.substring(line, F.lit(1), (F.length(line) / 2).cast("int")))
        .when(turn == 8, F.concat(F.lit("["), line, F.lit("]")))
        .when(turn == 9, F.lit(""))
        .when(turn == 6, F.regexp_replace(line, r'"return_code":\d+', '"return_code":"xx"'))
        .otherwise(line)
    )
    return events.select("event_id", damaged.alias("value"))


def capture_records(events: DataFrame) -> DataFrame:
    """Pre-exec captures with their finishing arguments; of every ten, one is
    not base64, one not JSON, one has odd environment entries, one no return code and
    one an end time with a blank instead of the ``T``."""
    turn = F.col("event_id") % 10
    entries = _env_entries()
    odd = F.concat(
        entries,
        F.array(F.lit("PS1=$ "), F.lit("no equals sign"), F.lit("GIT_PAGER=a=b"), F.lit("GIT_EDITOR="), F.lit("CI=1"), F.lit("CI=2")),
    )
    record = F.to_json(
        F.struct(
            F.concat(F.lit(" "), F.col("command"), F.lit(" ")).alias("command"),
            "pwd",
            wire_time(F.col("start_timestamp")).alias("start_timestamp"),
            F.when(turn == 5, odd).otherwise(entries).alias("environment"),
        )
    )
    body = F.when(turn == 8, F.concat(record, F.lit("}"))).when(turn == 9, F.lit("{not json")).otherwise(record)
    capture = F.when(turn == 7, F.lit("%%%")).otherwise(_base64(body))
    end = wire_time(F.col("end_timestamp"))
    return events.select(
        "event_id",
        capture.alias("capture"),
        F.when(turn == 6, F.lit("x")).otherwise(F.col("return_code").cast("string")).alias("return_code"),
        F.when(turn == 4, F.regexp_replace(end, "T", " ")).otherwise(end).alias("end_timestamp"),
        F.when(turn == 3, F.lit(None)).otherwise(F.col("hostname")).alias("hostname"),
        F.lit("").alias("ip_address"),
    )


def env_blobs(events: DataFrame) -> DataFrame:
    """The legacy form: one base64 text of ``K=V`` lines, with blank lines and lines without ``=``."""
    lines = F.concat(F.array(F.lit(""), F.lit("no equals sign")), _env_entries(), F.array(F.lit("GIT_PAGER=a=b")))
    blob = _base64(F.array_join(lines, "\n"))
    return events.select("event_id", F.when(F.col("event_id") % 10 == 7, "%%%").otherwise(blob).alias("blob"))


def _base64(text: Column) -> Column:
    # Without line breaks, as the hooks write it.
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", "")

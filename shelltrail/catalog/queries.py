"""One query per operator over the sample tables, for checks and timing.

Every callable takes (spark, sf_dir) and reads its tables whole. Results are
flat: maps become rows, times become time-zone-free timestamps, computed
fractions are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shelltrail.functions.policy import EnvPolicy, hash_value, without_capture_noise
from shelltrail.functions.text import char_ngrams, word_ngrams, words
from shelltrail.operators import directories, drift, filters, live, policy, predict, sequence, suggest, usage
from shelltrail.plans.ordered import Cuts
from shelltrail.session import scratch_path
from shelltrail.plans.once import worked_out
from shelltrail.sources import captures, events as event_source, history
from shelltrail.sources.activity import (
    AS_OF,
    capture_records,
    command_events,
    env_blobs,
    stream_of_commands,
    table,
    wire_lines,
    wire_struct,
)
from shelltrail.streaming import feeds, totals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HERE = "/home/u1/src/api"
CONTEXT = {
    "PWD": HERE,
    "HOME": "/home/u1",
    "USER": "u1",
    "SHELL": "/bin/bash",
    "TERM": "xterm",
    "ENVIRONMENT": "production",
    "NODE_ENV": "production",
    "AWS_PROFILE": "main",
}
MAPPED = ["PWD", "HOME", "USER", "SHELL", "NODE_ENV", "LANG"]
DEFAULT = EnvPolicy(version="2.0.0")
SCALARS = [
    "event_id", "command", "return_code", "start_timestamp", "end_timestamp", "pwd", "hostname", "config_version",
]


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(function(spark, sf_dir))

    QUERIES[function.__name__] = run
    return function


def flat(rows: DataFrame) -> DataFrame:
    """Plain column types that mean the same to every engine."""
    shown = []
    for field in rows.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 6)
        elif isinstance(field.dataType, T.BooleanType):
            column = column.cast("int")
        shown.append(column.alias(field.name))
    return rows.select(*shown)


def env_rows(rows: DataFrame, *also: str) -> DataFrame:
    return rows.select("event_id", *also, F.explode_outer("env").alias("key", "value")).where("key IS NOT NULL")


def stored(spark: SparkSession, rows: DataFrame, label: str) -> DataFrame:
    """Raw input as it lies in the shared folder before a job reads it."""
    path = scratch_path(spark, label)
    rows.write.parquet(path)
    return spark.read.parquet(path)


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, wire_lines(command_events(spark, sf_dir)), "lines")


def raw_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, capture_records(command_events(spark, sf_dir)), "captures")


def mapped_fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name,) for name in MAPPED], "key string")


# -- sources, ingest, sinks --


@query
def read_events(spark, sf_dir):
    path = scratch_path(spark, "ndjson")
    command_events(spark, sf_dir).select(F.to_json(wire_struct())).write.text(path)
    return event_source.read_events(spark, [path]).select(*SCALARS[1:], F.col("env")["API_KEY"].alias("api_key"))


@query
def stream_events(spark, sf_dir):
    source, out, check = (scratch_path(spark, name) for name in ("ndjson", "events", "check"))
    command_events(spark, sf_dir).select(F.to_json(wire_struct())).write.text(source)
    stream = event_source.stream_events(spark, source)
    feeds.store_batches(stream, out, check, mode="append").awaitTermination()
    return spark.read.parquet(out).select(*SCALARS[1:], F.col("env")["API_KEY"].alias("api_key"))


@query
def read_damaged_events(spark, sf_dir):
    path = scratch_path(spark, "ndjson")
    wire_lines(command_events(spark, sf_dir)).select("value").write.text(path)
    return event_source.read_events(spark, [path]).select("command", "return_code", "start_timestamp", "pwd")


@query
def stream_damaged_events(spark, sf_dir):
    source, out, check = (scratch_path(spark, name) for name in ("ndjson", "events", "check"))
    wire_lines(command_events(spark, sf_dir)).select("value").write.text(source)
    feeds.store_batches(event_source.stream_events(spark, source), out, check, mode="append").awaitTermination()
    return spark.read.parquet(out).select("command", "return_code", "start_timestamp", "pwd")


@query
def split_valid_invalid(spark, sf_dir):
    good, bad = event_source.split_valid_invalid(raw_lines(spark, sf_dir))
    parsed = event_source.parse_lines(good, ("event_id",))
    kept = parsed.select("event_id", F.lit("valid").alias("status"), "command", "return_code", "start_timestamp")
    return kept.unionByName(bad.select("event_id", F.lit("invalid").alias("status")), allowMissingColumns=True)


@query
def decode_captures(spark, sf_dir):
    good, bad = captures.decode_captures(raw_captures(spark, sf_dir), DEFAULT)
    kept = env_rows(good, "command", "pwd", "start_timestamp")
    return kept.unionByName(bad.select("event_id"), allowMissingColumns=True)


@query
def decode_env_blobs(spark, sf_dir):
    good, bad = captures.decode_env_blobs(stored(spark, env_blobs(command_events(spark, sf_dir)), "blobs"), DEFAULT)
    return env_rows(good).unionByName(bad.select("event_id"), allowMissingColumns=True)


@query
def assemble_events(spark, sf_dir):
    decoded, _ = captures.decode_captures(raw_captures(spark, sf_dir), DEFAULT)
    good, bad = captures.assemble_events(decoded, AS_OF, DEFAULT)
    kept = good.select(*SCALARS, "ip_address", F.size("env").alias("n_env"), F.lit("good").alias("status"))
    return kept.unionByName(bad.select("event_id", F.lit("bad").alias("status")), allowMissingColumns=True)


@query
def write_history(spark, sf_dir):
    path = scratch_path(spark, "history")
    history.write_history(command_events(spark, sf_dir), path)
    return filters.filter_time_range(history.read_history(spark, path), 72, AS_OF).select(
        *SCALARS, F.col("event_date").cast("string").alias("event_date")
    )


@query
def write_history_stream(spark, sf_dir):
    path, check = scratch_path(spark, "history"), scratch_path(spark, "check")
    feeds.write_history_stream(_stream(spark, sf_dir), path, check, {"availableNow": True}).awaitTermination()
    return filters.filter_time_range(history.read_history(spark, path), 72, AS_OF).select(
        *SCALARS, F.col("event_date").cast("string").alias("event_date")
    )


@query
def rewrite_history(spark, sf_dir):
    path = scratch_path(spark, "rewritten")
    once = policy.mask_environment(command_events(spark, sf_dir), EnvPolicy(hash_sensitive_values=False))
    history.rewrite_history(once, DEFAULT, path)
    return env_rows(history.read_history(spark, path), "config_version")


@query
def ingest_metrics(spark, sf_dir):
    return history.ingest_metrics(raw_lines(spark, sf_dir))


# -- projections, filters, predicates --


@query
def filter_by_directory(spark, sf_dir):
    return filters.filter_by_directory(command_events(spark, sf_dir), HERE).select(*SCALARS)


@query
def successful_commands(spark, sf_dir):
    return filters.successful_commands(command_events(spark, sf_dir)).select(*SCALARS)


@query
def failed_commands(spark, sf_dir):
    return filters.failed_commands(command_events(spark, sf_dir)).select(*SCALARS)


@query
def filter_time_range(spark, sf_dir):
    return filters.filter_time_range(command_events(spark, sf_dir), 100, AS_OF, until="2024-01-30 12:00:00").select(
        *SCALARS
    )


@query
def filter_env_equals(spark, sf_dir):
    return filters.filter_env_equals(command_events(spark, sf_dir), "NODE_ENV", "production").select(*SCALARS)


@query
def filter_env_exists(spark, sf_dir):
    return filters.filter_env_exists(command_events(spark, sf_dir, oldpwd=True), "OLDPWD").select(*SCALARS)


@query
def events_with_hashed_env(spark, sf_dir):
    masked = policy.mask_environment(command_events(spark, sf_dir), DEFAULT)
    return filters.events_with_hashed_env(masked).select(*SCALARS)


@query
def search_command_prefix(spark, sf_dir):
    return filters.search_command_prefix(command_events(spark, sf_dir), "Git").select("event_id", "command")


@query
def search_command_prefix_documents(spark, sf_dir):
    return filters.search_command_prefix(table(spark, sf_dir, "documents"), "thre", "text").select("doc_id", "lang")


@query
def search_command_match(spark, sf_dir):
    return filters.search_command_match(command_events(spark, sf_dir), "docker pods STATUS").select(
        "event_id", "command"
    )


@query
def search_command_match_conversations(spark, sf_dir):
    return filters.search_command_match(table(spark, sf_dir, "conversations"), "the and que", "text").select(
        "conv_id", "turn", "role"
    )


@query
def filter_subscription(spark, sf_dir):
    return filters.filter_subscription(
        command_events(spark, sf_dir), " hostname = host-3, return_code=1 ,ignored"
    ).select(*SCALARS)


@query
def match_subscriptions(spark, sf_dir):
    # A stored filter per nation: its key picks a host, every third one only wants failures.
    number = F.col("n_nationkey")
    host = F.concat(F.lit("host-"), (number % 7).cast("string"))
    wanted = F.when(
        number % 3 == 0, F.create_map(F.lit("hostname"), host, F.lit("return_code"), F.lit("1"))
    ).otherwise(F.create_map(F.lit("hostname"), host))
    asked = table(spark, sf_dir, "nation").select(F.col("n_name").alias("subscriber_id"), wanted.alias("filter"))
    return feeds.match_subscriptions(command_events(spark, sf_dir), asked).select("subscriber_id", *SCALARS)


@query
def history_report(spark, sf_dir):
    return filters.history_report(command_events(spark, sf_dir), HERE, 24 * 30, 25, AS_OF)


@query
def live_view_rows(spark, sf_dir):
    return filters.live_view_rows(command_events(spark, sf_dir))


@query
def live_view_conversations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"),
        F.col("text").alias("command"),
        F.when(F.col("role") == "user", 0).otherwise(1).alias("return_code"),
        F.concat_ws("/", F.lit(""), F.lit("chats"), F.col("conv_id").cast("string"), "role", "turn").alias("pwd"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("start_timestamp"),
        F.lit("2024-01-01 00:00:01").cast("timestamp").alias("end_timestamp"),
    )
    return filters.live_view_rows(rows)


@query
def project_source(spark, sf_dir):
    return filters.project_source(command_events(spark, sf_dir), ["env.PWD", "start_timestamp"])


# -- environment policy --


@query
def classify_env_vars(spark, sf_dir):
    return policy.classify_env_vars(command_events(spark, sf_dir, oldpwd=True), DEFAULT)


@query
def hash_values(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", hash_value(F.col("url")).alias("url"), hash_value(F.col("html")).alias("html")
    )


@query
def mask_environment(spark, sf_dir):
    return env_rows(policy.mask_environment(command_events(spark, sf_dir, oldpwd=True), DEFAULT))


CUSTOM = """{"version": "7", "hash_sensitive_values": false,
  "allowlist": {"exact": ["USER", "SHELL", "API_KEY", "TERM"], "patterns": ["^[A-Z]+_ENV$", "^DATA"]},
  "denylist": {"exact": ["SHELL"], "patterns": ["(?i)base", "(?i)_env"]}}"""


@query
def mask_environment_custom(spark, sf_dir):
    """Under a policy read from JSON."""
    return env_rows(policy.mask_environment(command_events(spark, sf_dir), EnvPolicy.from_json(CUSTOM)))


@query
def mask_simple(spark, sf_dir):
    return env_rows(policy.mask_simple(command_events(spark, sf_dir)))


@query
def capture_noise_filter(spark, sf_dir):
    entries = F.concat(
        F.array(F.lit("PS1=$ "), F.lit("BASH_ENV=x"), F.lit("_=/bin/ls"), F.lit("PS3=kept")),
        F.transform(F.map_entries("env"), lambda entry: F.concat(entry["key"], F.lit("="), entry["value"])),
    )
    kept = without_capture_noise(entries)
    return command_events(spark, sf_dir).select("event_id", F.explode(kept).alias("entry"))


@query
def policy_audit(spark, sf_dir):
    return policy.policy_audit(command_events(spark, sf_dir, oldpwd=True), DEFAULT)


@query
def leak_check(spark, sf_dir):
    lax = policy.mask_environment(command_events(spark, sf_dir), EnvPolicy(hash_sensitive_values=False))
    return policy.leak_check(lax, DEFAULT)


# -- joins --


@query
def env_context_match(spark, sf_dir):
    return suggest.env_context_match(command_events(spark, sf_dir), CONTEXT)


@query
def weight_lookup(spark, sf_dir):
    rows = command_events(spark, sf_dir)
    return predict.weight_lookup(rows, usage.time_weights(rows, "hour"), "hour").select("event_id", "hour_weight")


@query
def common_flag(spark, sf_dir):
    rows = usage.named_commands(command_events(spark, sf_dir))
    return predict.common_flag(rows, usage.command_name_frequency(rows, 3)).select("event_id", "is_common")


@query
def existing_directories(spark, sf_dir):
    rows = command_events(spark, sf_dir)
    inventory = rows.where(F.col("return_code") == 1).select("hostname", F.col("pwd").alias("path")).distinct()
    used = rows.select("hostname", F.col("pwd").alias("path")).distinct()
    return directories.existing_directories(used, inventory)


@query
def unmapped_fields(spark, sf_dir):
    return drift.unmapped_fields(command_events(spark, sf_dir), mapped_fields(spark), 24, AS_OF)


# -- aggregations --


@query
def return_code_distribution(spark, sf_dir):
    return usage.return_code_distribution(command_events(spark, sf_dir))


@query
def commands_over_time(spark, sf_dir):
    return usage.commands_over_time(command_events(spark, sf_dir), "1 hour")


@query
def top_commands(spark, sf_dir):
    return usage.top_commands(command_events(spark, sf_dir), 15, 1024)


@query
def command_name_frequency(spark, sf_dir):
    return usage.command_name_frequency(command_events(spark, sf_dir), 100)


@query
def hour_weights(spark, sf_dir):
    return usage.time_weights(command_events(spark, sf_dir), "hour")


@query
def weekday_weights(spark, sf_dir):
    return usage.time_weights(command_events(spark, sf_dir), "weekday")


@query
def transition_probabilities(spark, sf_dir):
    return sequence.transition_probabilities(command_events(spark, sf_dir))


@query
def directory_command_probabilities(spark, sf_dir):
    return sequence.directory_command_probabilities(command_events(spark, sf_dir, oldpwd=True))


@query
def command_usage(spark, sf_dir):
    scored = suggest.context_score(command_events(spark, sf_dir), HERE, CONTEXT, scoring="boost")
    best = scored.withColumn("context", F.lit("")).orderBy(*suggest.hit_order()).limit(20)
    return suggest.command_usage(suggest.hit_rank(best), [], AS_OF).drop("context")


@query
def directory_usage(spark, sf_dir):
    rows = command_events(spark, sf_dir)
    evidence = directories.cd_evidence(rows, [], 500, None).unionByName(directories.pwd_evidence(rows, [], 200))
    return directories.directory_usage(evidence, [], AS_OF)


@query
def env_field_usage(spark, sf_dir):
    return usage.env_field_usage(command_events(spark, sf_dir, oldpwd=True), 24, AS_OF, 1000)


@query
def config_version_counts(spark, sf_dir):
    return usage.config_version_counts(command_events(spark, sf_dir), AS_OF)


@query
def hashed_event_count(spark, sf_dir):
    return usage.hashed_event_count(policy.mask_environment(command_events(spark, sf_dir), DEFAULT), AS_OF)


@query
def env_type_consistency(spark, sf_dir):
    return drift.env_type_consistency(policy.mask_environment(command_events(spark, sf_dir), DEFAULT))


@query
def ingest_count(spark, sf_dir):
    return usage.ingest_count(command_events(spark, sf_dir))


@query
def distinct_fields(spark, sf_dir):
    return drift.distinct_fields(policy.env_entries(command_events(spark, sf_dir)).select("key"))


# -- order and windows --


@query
def previous_command(spark, sf_dir):
    return sequence.previous_command(command_events(spark, sf_dir)).select("event_id", "command", "previous_cmd")


@query
def previous_command_cut(spark, sf_dir):
    """With pieces so small that the sample is cut."""
    return sequence.previous_command(command_events(spark, sf_dir), cuts=Cuts(2)).select("event_id", "command", "previous_cmd")


@query
def next_command_cut(spark, sf_dir):
    return sequence.next_command(command_events(spark, sf_dir), cuts=Cuts(2)).select("event_id", "command", "next_cmd")


@query
def next_command(spark, sf_dir):
    return sequence.next_command(command_events(spark, sf_dir)).select("event_id", "command", "next_cmd")


@query
def recent_commands(spark, sf_dir):
    return sequence.recent_commands(command_events(spark, sf_dir), 20).select("event_id", "pwd", "command")


@query
def recent_commands_here(spark, sf_dir):
    return sequence.recent_commands(command_events(spark, sf_dir), 20, HERE).select("event_id", "pwd", "command")


@query
def last_n_events(spark, sf_dir):
    return sequence.last_n_events(command_events(spark, sf_dir), 20).select(*SCALARS, "user")


@query
def latest_directory(spark, sf_dir):
    return sequence.latest_directory(command_events(spark, sf_dir))


@query
def hit_rank(spark, sf_dir):
    scored = suggest.context_score(command_events(spark, sf_dir), HERE, CONTEXT, scoring="boost")
    best = scored.orderBy(*suggest.hit_order()).limit(40)
    return suggest.hit_rank(best).select("event_id", "score", "hit")


# -- sorts, limits, set operations --


@query
def history_order(spark, sf_dir):
    return sequence.history_order(command_events(spark, sf_dir)).select(*SCALARS, "user")


@query
def top_k_by_time(spark, sf_dir):
    rows = command_events(spark, sf_dir)
    return rows.orderBy(F.desc("start_timestamp"), F.desc("event_id")).limit(200).select(*SCALARS)


@query
def scan_cap(spark, sf_dir):
    return sequence.scan_cap(command_events(spark, sf_dir), 5000).select(*SCALARS)


@query
def score_order(spark, sf_dir):
    found = suggest.suggest_commands(command_events(spark, sf_dir), HERE, CONTEXT, 40, AS_OF, scoring="boost", best_hits=80)
    return found.select("command", "score", "frequency")


@query
def display_rows(spark, sf_dir):
    found = suggest.suggest_commands(command_events(spark, sf_dir), HERE, CONTEXT, 3, AS_OF, scoring="boost", best_hits=6)
    return filters.suggestion_rows(found, AS_OF)


@query
def evidence_union(spark, sf_dir):
    rows = command_events(spark, sf_dir)
    current = spark.range(1).select(F.lit(HERE).alias("cwd"))
    return (
        directories.cd_evidence(rows, [], 500, None)
        .drop("hostname")
        .unionByName(directories.pwd_evidence(rows, [], 200).drop("hostname"))
        .unionByName(directories.current_evidence(current, [], AS_OF))
    )


@query
def index_pattern_union(spark, sf_dir):
    base = scratch_path(spark, "logs")
    rows = command_events(spark, sf_dir)
    early = rows.where(F.col("start_timestamp") < "2024-01-15")
    late = rows.where(F.col("start_timestamp") >= "2024-01-15")
    history.write_history(early, f"{base}/old")
    history.write_history(late.drop("config_version"), f"{base}/new")
    logs = [event_source.read_events(spark, f"{base}/{name}", "parquet") for name in ("old", "new")]
    return event_source.union_logs(logs).select(*SCALARS)


@query
def unique_fields(spark, sf_dir):
    return policy.env_entries(command_events(spark, sf_dir, oldpwd=True)).select("key").distinct()


@query
def except_fields(spark, sf_dir):
    used = policy.env_entries(command_events(spark, sf_dir)).select("key").distinct()
    return used.join(mapped_fields(spark), "key", "left_anti")


# -- ranking and scoring --


@query
def context_score(spark, sf_dir):
    return suggest.context_score(command_events(spark, sf_dir), HERE, CONTEXT).select("event_id", "score")


@query
def match_statistics(spark, sf_dir):
    counted = suggest.match_statistics(command_events(spark, sf_dir))
    return counted.groupBy("kind", "key", "value").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("days"))


@query
def context_score_kept(spark, sf_dir):
    rows = command_events(spark, sf_dir)
    kept = stored(spark, suggest.match_statistics(rows), "statistics")
    return suggest.context_score(rows, HERE, CONTEXT, statistics=kept).select("event_id", "score")


@query
def context_score_intended(spark, sf_dir):
    return suggest.context_score(
        command_events(spark, sf_dir), HERE, CONTEXT, key_mode="intended", scoring="boost"
    ).select("event_id", "score")


@query
def suggest_commands(spark, sf_dir):
    masked = policy.mask_environment(command_events(spark, sf_dir), DEFAULT)
    return suggest.suggest_commands(masked, HERE, CONTEXT, 10, AS_OF, best_hits=20)


@query
def suggest_commands_all_hits(spark, sf_dir):
    masked = policy.mask_environment(command_events(spark, sf_dir), DEFAULT)
    return suggest.suggest_commands(masked, HERE, CONTEXT, 10, AS_OF)


@query
def suggest_commands_plain_contexts(spark, sf_dir):
    """Contexts without an environment, with an empty one, and with one variable."""
    asked = [("none", HERE, None), ("empty", HERE, {}), ("stage", HERE, {"NODE_ENV": "production"})]
    contexts = spark.createDataFrame(asked, "context_id string, pwd string, env map<string,string>")
    return suggest.suggest_commands_bulk(command_events(spark, sf_dir), contexts, 4, AS_OF, key_mode="intended", scoring="boost")


def _contexts(rows: DataFrame) -> DataFrame:
    """The newest event of every user is that user's current context."""
    newest = sequence.last_n_events(rows, 1, ["user"])
    return newest.select(F.col("user").alias("context_id"), "pwd", "env")


@query
def suggest_commands_bulk(spark, sf_dir):
    rows = command_events(spark, sf_dir)
    return suggest.suggest_commands_bulk(rows, stored(spark, _contexts(rows), "contexts"), 5, AS_OF, best_hits=10)


@query
def rank_directories(spark, sf_dir):
    return directories.rank_directories(command_events(spark, sf_dir), AS_OF, cwd=HERE, cap_cd=500, cap_pwd=200, limit=20)


@query
def rank_directories_fleet(spark, sf_dir):
    rows = command_events(spark, sf_dir)
    current = sequence.latest_directory(rows).select("hostname", "user", F.col("pwd").alias("cwd"))
    return directories.rank_directories(rows, AS_OF, cwd=current, cap_cd=500, cap_pwd=200, by=["hostname", "user"])


@query
def directory_labels(spark, sf_dir):
    rows = command_events(spark, sf_dir)
    return rows.select("pwd").distinct().select("pwd", directories.path_label(F.col("pwd")).alias("label"))


@query
def live_suggestions(spark, sf_dir):
    rows = sequence.last_n_events(command_events(spark, sf_dir), 20)
    return live.live_suggestions(rows)


# -- parsing and schema drift --


@query
def parse_commands(spark, sf_dir):
    rows = sequence.parse_commands(command_events(spark, sf_dir))
    return rows.select("event_id", "command_name", F.array_join("args", "|").alias("args"), "num_args")


@query
def parse_commands_conversations(spark, sf_dir):
    rows = sequence.parse_commands(table(spark, sf_dir, "conversations"), "text")
    return rows.select("conv_id", "turn", "command_name", F.array_join("args", "|").alias("args"), "num_args")


@query
def parse_commands_documents(spark, sf_dir):
    rows = sequence.parse_commands(table(spark, sf_dir, "documents"), "text")
    return rows.select("doc_id", "command_name", F.array_join("args", "|").alias("args"), "num_args")


@query
def command_records(spark, sf_dir):
    return sequence.command_records(command_events(spark, sf_dir, oldpwd=True))


@query
def char_ngram_counts(spark, sf_dir):
    # The count is local to the row: nothing is shuffled. In a sorted list equal grams stand together.
    rows = worked_out(command_events(spark, sf_dir).select("event_id", "command"), {"_grams": F.array_sort(char_ngrams(F.col("command")))})
    kinds = F.array_distinct("_grams")
    rows = worked_out(rows, {"_kinds": kinds, "_starts": F.transform(kinds, lambda gram: F.array_position("_grams", gram))})
    ends = F.concat(F.slice("_starts", F.lit(2), F.size("_starts")), F.array(F.size("_grams").cast("long") + 1))
    counted = F.zip_with("_starts", ends, lambda start, end: end - start)
    return rows.select("event_id", F.inline(F.arrays_zip(F.col("_kinds").alias("ngram"), counted.alias("n"))).alias("ngram", "n"))


@query
def char_ngram_documents(spark, sf_dir):
    counted = (
        table(spark, sf_dir, "documents")
        .select(F.explode(words(F.col("text"))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grams = counted.select(F.explode(word_ngrams(F.col("word"))).alias("ngram"), "n")
    return grams.groupBy("ngram").agg(F.sum("n").alias("n"))


@query
def ngram_vocabulary(spark, sf_dir):
    return predict.ngram_vocabulary(command_events(spark, sf_dir))


@query
def classify_env_values(spark, sf_dir):
    masked = policy.mask_environment(command_events(spark, sf_dir), DEFAULT)
    return drift.classify_env_values(masked, "basic")


@query
def classify_env_values_extended(spark, sf_dir):
    masked = policy.mask_environment(command_events(spark, sf_dir), DEFAULT)
    return drift.classify_env_values(masked, "extended")


@query
def classify_page_values(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("event_id"),
        F.create_map(F.lit("URL"), F.col("url"), F.lit("HTML"), F.col("html")).alias("env"),
    )
    return drift.classify_env_values(rows, "extended").select("event_id", "key", "value_class")


@query
def field_index_policy(spark, sf_dir):
    return drift.field_index_policy(command_events(spark, sf_dir, oldpwd=True))


@query
def drift_report(spark, sf_dir):
    return drift.drift_report(command_events(spark, sf_dir), mapped_fields(spark), AS_OF, threshold=3)


@query
def oversized_values(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.col("html").alias("command"),
        F.col("url").alias("pwd"),
        F.lit("host").alias("hostname"),
        F.create_map(F.lit("PAGE_URL"), F.col("url"), F.lit("PAGE"), F.col("html")).alias("env"),
    )
    return drift.oversized_values(pages)


@query
def version_staleness(spark, sf_dir):
    return drift.version_staleness(command_events(spark, sf_dir), "1.0.1")


# -- streams; each reads the whole table as a stream and is compared with its batch twin --


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream_of_commands(arriving)


def _stored(spark: SparkSession, output: DataFrame, mode: str) -> DataFrame:
    out, check = scratch_path(spark, "stream"), scratch_path(spark, "check")
    feeds.store_batches(output, out, check, mode).awaitTermination()
    return spark.read.parquet(out)


@query
def subscribe(spark, sf_dir):
    feed = feeds.subscribe(_stream(spark, sf_dir), "hostname=host-2,return_code=1")
    return _stored(spark, feed.select(*SCALARS), "append").drop("batch")


@query
def ingest_stream(spark, sf_dir):
    source, archive, published, bad, check = (
        scratch_path(spark, name) for name in ("lines", "archive", "published", "bad", "check")
    )
    wire_lines(command_events(spark, sf_dir)).write.parquet(source)
    lines = spark.readStream.schema("event_id long, value string").parquet(source)

    def publish(archived: DataFrame, number: int) -> None:
        feeds.subscribe(archived, "return_code=0").select("event_id").write.mode("overwrite").parquet(
            f"{published}/batch={number}"
        )

    feeds.ingest_stream(
        lines, DEFAULT, archive, check, publish, bad, ("event_id",), {"availableNow": True}
    ).awaitTermination()
    kept = spark.read.parquet(archive).select(
        "event_id", F.lit("archived").alias("status"), F.col("env")["API_KEY"].alias("api_key")
    )
    sent = spark.read.parquet(published).select("event_id", F.lit("published").alias("status"))
    refused = spark.read.parquet(bad).select("event_id", F.lit("invalid").alias("status"))
    return kept.unionByName(sent, allowMissingColumns=True).unionByName(refused, allowMissingColumns=True)


@query
def ingest_stream_masked(spark, sf_dir):
    """Lines that the capture side has masked already."""
    source, archive, check = (scratch_path(spark, name) for name in ("lines", "archive", "check"))
    masked = policy.mask_environment(command_events(spark, sf_dir), DEFAULT)
    masked.select("event_id", F.to_json(wire_struct()).alias("value")).write.parquet(source)
    lines = spark.readStream.schema("event_id long, value string").parquet(source)
    feeds.ingest_stream(lines, DEFAULT, archive, check, carried=("event_id",), trigger={"availableNow": True}).awaitTermination()
    return spark.read.parquet(archive).select("event_id", F.col("env")["API_KEY"].alias("api_key"))


def _recent(spark: SparkSession, stream: DataFrame, n: int) -> DataFrame:
    out, check = scratch_path(spark, "recent"), scratch_path(spark, "check")
    feeds.recent_events_stream(stream, out, check, n).awaitTermination()
    return feeds.latest_lists(spark, out)


@query
def recent_events_stream(spark, sf_dir):
    return _recent(spark, _stream(spark, sf_dir), 20).select("event_id", "hostname", "user", "command", "pwd")


@query
def recent_untimed_stream(spark, sf_dir):
    """Some events have no readable start time."""
    timed = F.when(F.col("event_id") % 7 != 3, F.col("start_timestamp"))
    listed = _recent(spark, _stream(spark, sf_dir).withColumn("start_timestamp", timed), 5)
    return listed.select("event_id", "hostname", "user", "command", "pwd")


@query
def live_suggestions_stream(spark, sf_dir):
    return live.live_suggestions(_recent(spark, _stream(spark, sf_dir), 20))


@query
def latest_directory_stream(spark, sf_dir):
    updates = _stored(spark, feeds.latest_directory_stream(_stream(spark, sf_dir)), "update")
    newest = F.max(F.struct("batch", "start_timestamp", "pwd")).alias("_n")
    return updates.groupBy("hostname", "user").agg(newest).select("hostname", "user", "_n.pwd", "_n.start_timestamp")


@query
def commands_over_time_stream(spark, sf_dir):
    counts = feeds.commands_over_time_stream(_stream(spark, sf_dir), "1 hour")
    updates = _stored(spark, counts, "update")
    return updates.groupBy("bucket").agg(F.max_by("n", "batch").alias("n"))


def _deduped(spark: SparkSession, stream: DataFrame) -> DataFrame:
    out, check = scratch_path(spark, "once"), scratch_path(spark, "check")
    feeds.dedupe_stream(stream, out, check, {"availableNow": True}).awaitTermination()
    return spark.read.parquet(out)


@query
def dedupe_stream(spark, sf_dir):
    twice = _stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _deduped(spark, twice).select(*SCALARS)


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in three files, a batch each: the newest third of its time comes first, and some of it comes again."""
    rows = command_events(spark, sf_dir)
    first, last = rows.agg(F.min(F.unix_seconds("start_timestamp")), F.max(F.unix_seconds("start_timestamp"))).first()
    part = F.floor((F.unix_seconds("start_timestamp") - first) * 3 / (last - first + 1))
    folder = scratch_path(spark, "late")
    for number in (2, 1, 0):
        again = (part == 2) & (F.col("event_id") % 3 == 0) if number < 2 else F.lit(False)
        rows.where((part == number) | again).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query
def dedupe_late_stream(spark, sf_dir):
    return _deduped(spark, _late(spark, sf_dir)).select(*SCALARS)


@query
def commands_over_time_late_stream(spark, sf_dir):
    once = _late(spark, sf_dir).dropDuplicates(["event_id"])
    updates = _stored(spark, feeds.commands_over_time_stream(once, "1 hour"), "update")
    return updates.groupBy("bucket").agg(F.max_by("n", "batch").alias("n"))


@query
def stream_metrics(spark, sf_dir):
    stream = feeds.stream_metrics(_stream(spark, sf_dir), "feed")
    out, check = scratch_path(spark, "stream"), scratch_path(spark, "check")
    running = feeds.store_batches(stream.select("event_id", "return_code"), out, check, "append")
    running.awaitTermination()
    reports = [progress["observedMetrics"]["feed"] for progress in running.recentProgress if progress["numInputRows"]]
    rows = [(report["published"], report["failed"]) for report in reports]
    counted = spark.createDataFrame(rows, "published long, failed long")
    return counted.agg(F.sum("published").alias("published"), F.sum("failed").alias("failed"))


@query
def stream_metric_totals(spark, sf_dir):
    """The totals that a listener has kept, over three micro-batches and a restart."""
    kept, check, out = (scratch_path(spark, name) for name in ("totals", "check", "stream"))
    stream = feeds.stream_metrics(_late(spark, sf_dir), "feed").select("event_id", "return_code")
    listener = totals.MetricTotals(spark, kept)
    spark.streams.addListener(listener)
    try:
        for _ in range(2):
            running = feeds.store_batches(stream, out, check, "append")
            running.awaitTermination()
            listener.catch_up(running)
    finally:
        spark.streams.removeListener(listener)
    return totals.metric_totals(spark, kept).select("metric", "total", "batches")


# -- models --


def _features(good: DataFrame, **sizes) -> DataFrame:
    fitted = predict.CommandFeatures.fit(good, **sizes)
    grams = F.slice(vector_to_array("features"), 1, len(fitted.vocabulary))
    return fitted.transform(good).select(
        "event_id",
        "hour_weight",
        "weekday_weight",
        "is_common",
        "num_args",
        F.aggregate(grams, F.lit(0.0), lambda sum, n: sum + n).cast("long").alias("n_grams"),
        F.size(F.filter(grams, lambda n: n > 0)).cast("long").alias("gram_kinds"),
    )


@query
def command_features(spark, sf_dir):
    return _features(filters.successful_commands(command_events(spark, sf_dir)))


@query
def command_features_few(spark, sf_dir):
    """So few n-grams and names that most are none of them."""
    return _features(filters.successful_commands(command_events(spark, sf_dir)), vocabulary_size=50, common_size=2)


def _model(spark: SparkSession, sf_dir: str, **sizes) -> tuple[predict.NextCommandModel, DataFrame]:
    """A forest of 10 trees of depth 8 unless asked for the operator's own sizes."""
    rows = command_events(spark, sf_dir)
    return predict.train_next_command(rows, **(sizes or {"trees": 10, "max_depth": 8})), rows


#: What the operator does when it is asked for nothing.
FULL_SIZE = {"trees": 100, "max_depth": 30}


@query
def train_next_command(spark, sf_dir):
    """What was learned from: every label with its rows, and the rows of either part."""
    model, rows = _model(spark, sf_dir)
    labels = spark.createDataFrame([(name,) for name in model.labels], "name string")
    followed = sequence.next_command(filters.successful_commands(rows)).groupBy(F.col("next_cmd").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    parts = spark.createDataFrame([("rows", "train", model.train_rows), ("rows", "test", model.test_rows)], "fact string, name string, n long")
    return labels.join(followed, "name").select(F.lit("label").alias("fact"), "name", "n").unionByName(parts)


@query
def evaluate_accuracy(spark, sf_dir):
    """The forest at full size next to always saying the most frequent command of the test rows. The sample log is random, so
    it can only be held to be no worse than that, within two standard errors."""
    model, rows = _model(spark, sf_dir, **FULL_SIZE)
    followed = sequence.next_command(filters.successful_commands(rows)).where(~predict.is_training_row())
    shares = followed.groupBy("next_cmd").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_test"), (F.max("n") / F.sum("n")).alias("share"))
    worse = F.col("share") - 2 * F.sqrt(F.col("share") * (1 - F.col("share")) / F.col("n_test"))
    return shares.select("n_test", F.round("share", 6).alias("majority_share"), (F.lit(model.accuracy) >= worse).cast("int").alias("not_worse"))


@query
def predict_next_command(spark, sf_dir):
    model, rows = _model(spark, sf_dir, **FULL_SIZE)
    found = predict.predict_next_command(model, rows, ["hostname", "user"], 5)
    places = F.array_sort(F.collect_list(F.struct("place", "probability", "command")))
    listed = found.groupBy("hostname", "user").agg(places.alias("p"))
    steps = F.sequence(F.lit(1), F.size("p"))
    ordered = F.forall(steps, lambda i: (F.element_at("p", i)["place"] == i) & ((i == 1) | (F.element_at("p", F.greatest(i - 1, F.lit(1)))["probability"] >= F.element_at("p", i)["probability"])))
    named = F.forall("p", lambda x: x["command"].isin(*model.labels))
    return listed.select("hostname", "user", F.size("p").alias("n_places"), ordered.alias("in_order"), named.alias("all_are_commands"))


@query
def top_k_probabilities(spark, sf_dir):
    model, rows = _model(spark, sf_dir)
    scored = model.forest.transform(model.features.transform(filters.successful_commands(rows)))
    best = predict.top_k_probabilities(scored, model.labels, ["event_id"], len(model.labels))
    each = best.groupBy("event_id").agg(F.sum("probability").alias("sum"), F.count_distinct("command").alias("n"))
    return each.agg(
        F.count(F.lit(1)).alias("n_events"),
        (F.max(F.abs(F.col("sum") - 1)) < 1e-6).alias("sums_to_one"),
        (F.min("n") == len(model.labels)).alias("complete"),
    )


@query
def markov_next_command(spark, sf_dir):
    return sequence.markov_next_command(command_events(spark, sf_dir), 3).select(
        "prev_name", "rank", "next_name", "n", "probability"
    )

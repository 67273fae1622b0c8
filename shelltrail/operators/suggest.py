"""Commands that fit a context: same directory, successful, in a similar environment."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelltrail.functions.policy import EnvPolicy
from shelltrail.functions.times import age_hours
from shelltrail.operators.policy import env_entries
from shelltrail.plans.top import first_per_key

# The weight of a matching variable, the names that are left out of the score, the
# points for a use within so many days, and the words of a reason.
BOOSTS = {
    3.0: ["NODE_ENV", "RAILS_ENV", "ENVIRONMENT", "AWS_PROFILE", "KUBERNETES_NAMESPACE"],
    2.0: ["USER", "HOME", "SHELL"],
}
DEFAULT_BOOST = 1.5
SKIPPED_PARTS = ["HIST", "LESS", "LS_COLORS", "TERM", "PWD", "_"]
RECENCY = [(1, 2.0), (7, 1.0), (30, 0.5)]
WORKFLOWS = [(["git"], "git workflow"), (["docker"], "docker operations"), (["kubectl", "k8s"], "kubernetes")]
SIMILAR = "similar directory"


def is_scored(key: str, key_mode: str = "literal") -> bool:
    """Whether a context variable takes part in the score.

    ``literal`` leaves out every name that contains one of the parts, which
    includes every name with an underscore. ``intended`` reads the underscore as
    the shell variable of that name.
    """
    if key_mode == "literal":
        return not any(part in key for part in SKIPPED_PARTS)
    if key_mode == "intended":
        return key != "_" and not any(part in key for part in SKIPPED_PARTS if part != "_")
    raise ValueError(f"unknown key mode: {key_mode}")


def boost(key: str) -> float:
    return next((weight for weight, names in BOOSTS.items() if key in names), DEFAULT_BOOST)


def boost_column(key: Column) -> Column:
    found = None
    for weight, names in BOOSTS.items():
        found = (found if found is not None else F).when(key.isin(*names), weight)
    return found.otherwise(DEFAULT_BOOST)


def scored_column(key: Column, key_mode: str = "literal") -> Column:
    if key_mode == "literal":
        left_out = [key.contains(part) for part in SKIPPED_PARTS]
    else:
        left_out = [key.contains(part) for part in SKIPPED_PARTS if part != "_"] + [key == "_"]
    skipped = left_out[0]
    for condition in left_out[1:]:
        skipped = skipped | condition
    return ~skipped


def rarity(total: Column, matching: Column) -> Column:
    """How much an exact match says: less, the more events match."""
    return F.log(1 + (total - matching + 0.5) / (matching + 0.5))


def _equals(key: str, value: str) -> Column:
    return F.coalesce(F.col("env")[key] == value, F.lit(False))


def _sum(parts: list[Column], empty: Column) -> Column:
    total = empty
    for part in parts:
        total = total + part
    return total


def settled(score: Column) -> Column:
    """Without the last bits, so that the order of a sum never decides between equal scores."""
    return F.round(score, 9)


def env_context_match(events: DataFrame, context: dict[str, str]) -> DataFrame:
    """Per event, how many context variables it shares and the sum of their boosts. Row by row, no join."""
    shared = [(_equals(key, value).cast("int"), boost(key)) for key, value in sorted(context.items())]
    return events.select(
        "event_id",
        _sum([match for match, _ in shared], F.lit(0)).alias("matches"),
        _sum([match * weight for match, weight in shared], F.lit(0.0)).alias("boost"),
    ).where(F.col("matches") > 0)


def match_weights(events: DataFrame, pwd: str, scored: dict[str, str]) -> DataFrame:
    """One row: the rarity of the directory and of every context variable, from one pass over the whole log."""
    counts = [
        rarity(F.count("pwd"), F.count_if(F.col("pwd") == pwd)).alias("_pwd"),
        *[
            rarity(F.count(F.col("env")[key]), F.count_if(_equals(key, value))).alias(f"_{i}")
            for i, (key, value) in enumerate(scored.items())
        ],
    ]
    names = ["_pwd", *[f"_{i}" for i in range(len(scored))]]
    return events.agg(*counts).select(F.array(*names).alias("weights"))


DIRECTORY = "directory"


def match_statistics(events: DataFrame, key_mode: str = "literal") -> DataFrame:
    """day, kind, key, value, n: per day the events of each directory and of each scored variable's value.

    Days add up, so a job that keeps the table counts the new day only. Kind ``directory`` has no key. An event without
    a time is in the null day.
    """
    dated = events.withColumn("day", F.to_date("start_timestamp"))
    places = dated.where(F.col("pwd").isNotNull()).select("day", F.lit(DIRECTORY).alias("kind"), F.lit("").alias("key"), F.col("pwd").alias("value"))
    entries = dated.select("day", F.lit("variable").alias("kind"), F.explode("env").alias("key", "value"))
    scored = entries.where(scored_column(F.col("key"), key_mode) & F.col("value").isNotNull())
    return places.unionByName(scored).groupBy("day", "kind", "key", "value").agg(F.count(F.lit(1)).alias("n"))


def kept_weights(statistics: DataFrame, pwd: str, scored: dict[str, str]) -> DataFrame:
    """The row of ``match_weights`` from a table of ``match_statistics`` instead of the log."""
    n = F.col("n")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    place = F.col("kind") == DIRECTORY
    weights = [rarity(total(place), total(place & (F.col("value") == pwd)))]
    for key, value in scored.items():
        own = ~place & (F.col("key") == key)
        weights.append(rarity(total(own), total(own & (F.col("value") == value))))
    return statistics.agg(F.array(*weights).alias("weights"))


def context_score(
    events: DataFrame,
    pwd: str,
    env: dict[str, str],
    key_mode: str = "literal",
    scoring: str = "bm25",
    statistics: DataFrame | None = None,
) -> DataFrame:
    """Successful events of the directory with their ``score`` for the context.

    ``bm25`` weighs each match by how rare it is in the log and adds the constant
    share of the two required clauses; ``boost`` is the plain sum of boosts. With
    ``statistics`` (of the same key mode) the log is only read for the directory.
    """
    scored = {key: env[key] for key in sorted(env) if is_scored(key, key_mode)}
    hits = events.where((F.col("pwd") == pwd) & (F.col("return_code") == 0))
    if scoring == "boost":
        parts = [_equals(key, value).cast("double") * boost(key) for key, value in scored.items()]
        return hits.withColumn("score", settled(_sum(parts, F.lit(0.0))))
    if scoring != "bm25":
        raise ValueError(f"unknown scoring: {scoring}")
    weights = match_weights(events, pwd, scored) if statistics is None else kept_weights(statistics, pwd, scored)
    weighted = hits.withColumn("_weights", weights.scalar())
    parts = [
        F.when(_equals(key, value), F.col("_weights")[i + 1] * boost(key)).otherwise(0.0)
        for i, (key, value) in enumerate(scored.items())
    ]
    return weighted.withColumn("score", settled(_sum(parts, F.col("_weights")[0] + 1.0))).drop("_weights")


def reason(matches: Column) -> Column:
    """Why a command is suggested."""
    workflows = [F.when(reduce(or_, [F.col("command").contains(word) for word in words]), text) for words, text in WORKFLOWS]
    parts = F.concat_ws(", ", F.when(matches > 0, F.concat(matches.cast("string"), F.lit(" env vars match"))), *workflows)
    return F.when(parts == "", SIMILAR).otherwise(parts)


def recency_score(last_used: Column, as_of) -> Column:
    days = age_hours(last_used, as_of) / 24
    score = None
    for limit, value in RECENCY:
        score = (score if score is not None else F).when(days < limit, value)
    return score.otherwise(0.0)


def hit_order() -> list[Column]:
    return [F.desc("score"), F.desc("start_timestamp"), F.asc("event_id")]


def hit_rank(hits: DataFrame) -> DataFrame:
    """``hit`` numbers by score and time. Only for the few hits of a top-k, which fit one task."""
    return hits.withColumn("hit", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*hit_order())))


def command_usage(ranked: DataFrame, by: list[str], as_of) -> DataFrame:
    """Hits to one row per command: the newest hit's score, the best hit's reason, plus frequency and recency."""
    used = ranked.groupBy(*by, "command").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.max("start_timestamp").alias("last_used"),
        F.max_by("score", F.struct("start_timestamp", -F.col("hit"))).alias("_score"),
        F.min_by("context", "hit").alias("context"),
    )
    final = F.col("_score") + F.col("frequency") * 0.1 + recency_score(F.col("last_used"), as_of)
    return used.withColumn("score", settled(final)).drop("_score")


def suggest_commands(
    events: DataFrame,
    pwd: str,
    env: dict[str, str],
    limit: int,
    as_of,
    key_mode: str = "literal",
    scoring: str = "bm25",
    best_hits: int | None = None,
    mask: EnvPolicy | None = None,
    statistics: DataFrame | None = None,
) -> DataFrame:
    """The best ``limit`` commands for one context.

    Frequency and last use count within all hits of the directory, or within the
    ``best_hits`` best of them. ``mask`` is the policy that the log was stored
    under, so that hashed variables can match.
    """
    env = masked_context(mask, env, events.sparkSession) if mask else env
    shared = _sum([_equals(key, value).cast("int") for key, value in sorted(env.items())], F.lit(0))
    hits = context_score(events, pwd, env, key_mode, scoring, statistics).select(
        "event_id", "command", "start_timestamp", "score", reason(shared).alias("context")
    )
    if best_hits is None:
        # Every hit counts, so the order within a command stands in for the overall rank.
        ordered = hits.withColumn("hit", F.struct(-F.col("score"), -F.unix_micros("start_timestamp"), "event_id"))
        used = ordered.groupBy("command").agg(
            F.count(F.lit(1)).alias("frequency"),
            F.max("start_timestamp").alias("last_used"),
            F.max_by("score", F.struct("start_timestamp", "score", -F.col("event_id"))).alias("_score"),
            F.min_by("context", "hit").alias("context"),
        )
        final = F.col("_score") + F.col("frequency") * 0.1 + recency_score(F.col("last_used"), as_of)
        suggestions = used.withColumn("score", settled(final))
    else:
        best = hits.orderBy(*hit_order()).limit(best_hits)
        suggestions = command_usage(hit_rank(best), [], as_of)
    return (
        suggestions.withColumn("directory", F.lit(pwd))
        .select("command", "score", "frequency", "last_used", "directory", "context")
        .orderBy(F.desc("score"), "command")
        .limit(limit)
    )


def masked_context(policy: EnvPolicy, env: dict[str, str], spark) -> dict[str, str]:
    """The context as the policy would have stored it, so that hashed variables can match."""
    row = spark.range(1).select(
        policy.masked(F.create_map(*[F.lit(x) for pair in env.items() for x in pair])).alias("env")
    )
    return dict(row.first()["env"] or {})


def suggest_commands_bulk(
    events: DataFrame,
    contexts: DataFrame,
    limit: int,
    as_of,
    key_mode: str = "literal",
    scoring: str = "bm25",
    best_hits: int | None = None,
    mask: EnvPolicy | None = None,
) -> DataFrame:
    """Suggestions for many contexts (context_id, pwd, env) at once, each as ``suggest_commands`` gives them.

    Events of a directory whose scored variables are equal score the same in
    every context. So before contexts and events meet on the directory, they are
    counted per such profile and command, or with ``best_hits`` cut to as many of
    each profile. Equal contexts are answered once; a context without an
    environment has an empty one.
    """
    no_env = F.create_map().cast("map<string,string>")
    env = F.coalesce(mask.masked(F.col("env")) if mask else F.col("env"), no_env)
    asked = contexts.withColumn("env", env).withColumn("_ask", F.to_json(_sorted_entries(F.col("env"))))
    weighted = _weighted_contexts(events, asked, key_mode, scoring)

    scored = F.map_filter("_seen", lambda key, _: scored_column(key, key_mode))
    profiled = (
        events.where(F.col("return_code") == 0)
        .join(asked.select("pwd").distinct(), "pwd", "left_semi")
        .withColumn("_seen", F.coalesce("env", no_env))
        .withColumn("_profile", F.to_json(_sorted_entries(scored)))
        .select("event_id", "command", "start_timestamp", "pwd", "_seen", "_profile")
    )
    newest_first = [F.desc("start_timestamp"), F.asc("event_id")]
    if best_hits is None:
        latest = F.struct("start_timestamp", -F.col("event_id"))
        candidates = profiled.groupBy("pwd", "_profile", "command").agg(
            F.count(F.lit(1)).alias("_n"),
            F.max_by("event_id", latest).alias("event_id"),
            F.max("start_timestamp").alias("start_timestamp"),
            F.max_by("_seen", latest).alias("_seen"),
        )
    else:
        candidates = first_per_key(profiled, ["pwd", "_profile"], newest_first, best_hits, "event_id").withColumn("_n", F.lit(1))

    matched = F.filter("_clauses", lambda clause: F.col("_seen")[clause["key"]] == clause["value"])
    total = F.aggregate("_matched", F.col("_base"), lambda sum, clause: sum + clause["weight"])
    hits = (
        candidates.drop("_profile")
        .join(weighted, "pwd")
        .withColumn("_matched", matched)
        .select(
            "pwd",
            "_ask",
            "event_id",
            "command",
            "start_timestamp",
            "_n",
            settled(total).alias("score"),
            reason(F.size("_matched")).alias("context"),
        )
    )
    keys = ["pwd", "_ask"]
    if best_hits is None:
        hit = F.struct(-F.col("score"), -F.unix_micros("start_timestamp"), "event_id")
        used = hits.groupBy(*keys, "command").agg(
            F.sum("_n").alias("frequency"),
            F.max("start_timestamp").alias("last_used"),
            F.max_by("score", F.struct("start_timestamp", "score", -F.col("event_id"))).alias("_score"),
            F.min_by("context", hit).alias("context"),
        )
        final = F.col("_score") + F.col("frequency") * 0.1 + recency_score(F.col("last_used"), as_of)
        used = used.withColumn("score", settled(final)).drop("_score")
    else:
        used = command_usage(first_per_key(hits, keys, hit_order(), best_hits, "event_id", rank="hit"), keys, as_of)
    best = first_per_key(used, keys, [F.desc("score"), F.asc("command")], limit, "command", rank="place")
    return (
        asked.select("context_id", "pwd", "_ask")
        .join(best, keys)
        .select("context_id", "place", "command", "score", "frequency", "last_used", F.col("pwd").alias("directory"), "context")
    )


def _sorted_entries(env: Column) -> Column:
    return F.array_sort(F.map_entries(env))


def _weighted_contexts(events: DataFrame, asked: DataFrame, key_mode: str, scoring: str) -> DataFrame:
    """The distinct contexts: their clauses (key, value, weight) as a list, and the score of a hit without any match."""
    distinct = asked.groupBy("pwd", "_ask").agg(F.any_value("env").alias("_wanted"))
    clauses = distinct.select("pwd", "_ask", F.explode_outer("_wanted").alias("key", "value"))
    boosted = F.when(scored_column(F.col("key"), key_mode), boost_column(F.col("key"))).otherwise(0.0)
    if scoring == "bm25":
        weighed = clauses.join(_entry_rarity(events, asked, key_mode), ["key", "value"], "left")
        weight = boosted * F.coalesce("_rarity", F.lit(0.0))
    else:
        weighed, weight = clauses, boosted
    # A list is as long as one context has variables.
    listed = weighed.groupBy("pwd", "_ask").agg(
        F.array_sort(F.collect_list(F.struct("key", "value", weight.alias("weight")))).alias("_clauses")
    )
    if scoring == "bm25":
        return listed.join(_pwd_weights(events, asked), "pwd").withColumn("_base", F.col("_pwd_weight") + 1.0)
    return listed.withColumn("_base", F.lit(0.0))


def _entry_rarity(events: DataFrame, contexts: DataFrame, key_mode: str) -> DataFrame:
    """The rarity of each scored (key, value) that any context asks for. Other values are dropped before any shuffle
    that the plan can spare."""
    wanted = contexts.select(F.explode("env").alias("key", "value")).where(scored_column(F.col("key"), key_mode)).distinct()
    entries = env_entries(events).where(scored_column(F.col("key"), key_mode))
    per_value = entries.join(wanted, ["key", "value"], "left_semi").groupBy("key", "value").agg(F.count(F.lit(1)).alias("_n"))
    per_key = entries.groupBy("key").agg(F.count(F.lit(1)).alias("_total"))
    return (
        wanted.join(per_value, ["key", "value"], "left")
        .join(per_key, "key", "left")
        .select(
            "key",
            "value",
            rarity(F.coalesce("_total", F.lit(0)), F.coalesce("_n", F.lit(0))).alias("_rarity"),
        )
    )


def _pwd_weights(events: DataFrame, contexts: DataFrame) -> DataFrame:
    total = events.agg(F.count("pwd")).scalar()
    asked = contexts.select("pwd").distinct()
    return (
        events.join(asked, "pwd", "left_semi")
        .groupBy("pwd")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("pwd", rarity(total, F.col("_n")).alias("_pwd_weight"))
    )

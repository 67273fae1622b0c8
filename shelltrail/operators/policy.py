"""The environment policy over whole logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelltrail.functions.policy import HASH, HASHED_VALUE, PLAIN, SIMPLE_POLICY, EnvPolicy


def env_entries(events: DataFrame) -> DataFrame:
    """One row per event and variable: (event_id, key, value).

    The outer form comes without a guard on the map's size, for which a map that
    is computed on the fly would be computed again.
    """
    return events.select("event_id", F.explode_outer("env").alias("key", "value")).where(F.col("key").isNotNull())


def classify_env_vars(events: DataFrame, policy: EnvPolicy) -> DataFrame:
    return env_entries(events).withColumn("verdict", policy.verdict(F.col("key")))


def mask_environment(events: DataFrame, policy: EnvPolicy, keep_hashed: bool = False) -> DataFrame:
    """Drops, hashes or keeps every variable, inside the row: no shuffle. ``keep_hashed`` leaves hashed values as they are."""
    return events.withColumn("env", policy.masked(F.col("env"), keep_hashed))


def mask_simple(events: DataFrame) -> DataFrame:
    return mask_environment(events, SIMPLE_POLICY)


def policy_audit(events: DataFrame, policy: EnvPolicy) -> DataFrame:
    """What a policy would keep: per variable its verdict and events, and a total
    row (null key) with the number of variables seen and captured."""
    counted = env_entries(events).groupBy("key").agg(F.count(F.lit(1)).alias("n_events"))
    # Judged once per name; from here on the data is one row per variable name.
    judged = counted.withColumn("verdict", policy.verdict(F.col("key")))
    kept = F.col("verdict").isin(HASH, PLAIN)
    both = judged.rollup("key").agg(
        F.min("verdict").alias("verdict"),
        F.sum("n_events").alias("n_events"),
        F.count(F.lit(1)).alias("n_variables"),
        F.count_if(kept).alias("n_captured"),
        F.grouping("key").alias("is_total"),
    )
    return both.withColumn("verdict", F.when(F.col("is_total") == 0, F.col("verdict")))


def leak_check(events: DataFrame, policy: EnvPolicy) -> DataFrame:
    """Variables that the policy hashes but that are stored in plaintext, with the number of events."""
    exposed = env_entries(events).where(~F.col("value").rlike(HASHED_VALUE))
    counted = exposed.groupBy("key").agg(F.count(F.lit(1)).alias("n_events"))
    return counted.where(policy.verdict(F.col("key")) == HASH)

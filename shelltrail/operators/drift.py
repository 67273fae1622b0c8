"""Schema drift of the recorded environment: new variables, changing types, stale policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelltrail.functions.values import COLUMN_LIMITS, SUGGESTED_NAME, name_policy, search_limit, value_class
from shelltrail.operators.policy import env_entries
from shelltrail.operators.usage import count_rows, env_field_usage


def classify_env_values(events: DataFrame, mode: str = "basic") -> DataFrame:
    return env_entries(events).withColumn("value_class", value_class(F.col("value"), mode))


def env_type_consistency(events: DataFrame, mode: str = "basic") -> DataFrame:
    """Per variable the events of each value class, and whether it has more than one."""
    counted = (
        env_entries(events)
        .groupBy("key", value_class(F.col("value"), mode).alias("value_class"))
        .agg(count_rows().alias("n_events"))
    )
    # A variable has at most as many rows here as there are classes.
    classes = counted.groupBy("key").agg(F.collect_list(F.struct("value_class", "n_events")).alias("_classes"))
    return classes.select(
        "key", F.inline("_classes"), (F.size("_classes") == 1).alias("consistent")
    )


def distinct_fields(mapped: DataFrame) -> DataFrame:
    """The distinct mapped names and how many entries there were."""
    return mapped.groupBy("key").agg(count_rows().alias("n_entries"))


def unmapped_fields(events: DataFrame, mapped: DataFrame, hours: int, as_of, size: int | None = None) -> DataFrame:
    """Variables used lately that the mapping (key) does not know: all of them, or the ``size`` most used."""
    unmapped = env_field_usage(events, hours, as_of).join(mapped.select("key").distinct(), "key", "left_anti")
    return unmapped if size is None else unmapped.orderBy(F.desc("n_events"), "key").limit(size)


def drift_report(
    events: DataFrame, mapped: DataFrame, as_of, hours: int = 24, threshold: int = 10, show: int = 20, suggest: int = 10
) -> DataFrame:
    """A status row, the most used unmapped variables, and those worth allowing, as (section, place, key, n).

    All variables are counted; only the two lists are cut, to ``show`` and ``suggest`` rows.
    """
    used = env_field_usage(events, hours, as_of)
    marked = used.join(mapped.select("key").distinct().withColumn("_mapped", F.lit(True)), "key", "left")
    unmapped = marked.where(F.col("_mapped").isNull())
    counts = marked.agg(
        F.count_if(F.col("_mapped").isNull()).alias("n_unmapped"),
        count_rows().alias("fields_in_use"),
    )
    status = counts.select(
        F.lit("status").alias("section"),
        F.lit(1).alias("place"),
        F.when(F.col("n_unmapped") > threshold, "alert").otherwise("ok").alias("key"),
        F.col("n_unmapped").alias("n"),
    )
    in_use = counts.select(
        F.lit("fields_in_use").alias("section"),
        F.lit(1).alias("place"),
        F.lit("").alias("key"),
        F.col("fields_in_use").alias("n"),
    )
    alert = counts.select(F.col("n_unmapped") > threshold).scalar()

    def section(name: str, rows: DataFrame, most: int) -> DataFrame:
        best = rows.orderBy(F.desc("n_events"), "key").limit(most)
        listed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("n_events")).alias("order"), "key"))).alias("_all"))
        placed = listed.where(alert).select(F.posexplode("_all").alias("place", "_row"))
        return placed.select(
            F.lit(name).alias("section"),
            (F.col("place") + 1).alias("place"),
            F.col("_row.key").alias("key"),
            (-F.col("_row.order")).alias("n"),
        )

    wanted = unmapped.where(F.col("key").rlike(SUGGESTED_NAME))
    return status.unionByName(in_use).unionByName(section("unmapped", unmapped, show)).unionByName(
        section("suggestion", wanted, suggest)
    )


def field_index_policy(events: DataFrame) -> DataFrame:
    """Per variable how it would be stored, with its events: which ones deserve a column of their own."""
    used = events.select(F.explode(F.map_keys("env")).alias("key")).groupBy("key").agg(count_rows().alias("n_events"))
    rules = name_policy(F.col("key"))
    return used.select("key", "n_events", *[rule.alias(name) for name, rule in rules.items()])


def oversized_values(events: DataFrame) -> DataFrame:
    """Per column or variable, the events whose value is stored but too long to be searched."""
    columns = F.array(
        *[
            F.struct(F.lit(name).alias("field"), (F.length(name) > limit).alias("oversized"))
            for name, limit in COLUMN_LIMITS.items()
        ]
    )
    variables = F.transform(
        F.coalesce(F.map_entries("env"), F.array().cast("array<struct<key:string,value:string>>")),
        lambda entry: F.struct(
            F.concat(F.lit("env."), entry["key"]).alias("field"),
            (F.length(entry["value"]) > search_limit(entry["value"])).alias("oversized"),
        ),
    )
    checked = events.select(F.inline(F.filter(F.concat(columns, variables), lambda item: item["oversized"])))
    return checked.groupBy("field").agg(count_rows().alias("n_events"))


def version_staleness(events: DataFrame, current: str) -> DataFrame:
    """Events written under another policy version, or none, next to those under the current one."""
    stale = ~F.col("config_version").eqNullSafe(current)
    return events.groupBy("config_version", stale.alias("stale")).agg(count_rows().alias("n_events"))



"""The first n rows of every key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per_key(
    rows: DataFrame, by: list[str], order: list[Column], n: int, tie: str, rank: str | None = None, shards: int = 32
) -> DataFrame:
    """Keeps the first ``n`` rows per key in ``order``.

    Both windows are cut to n rows per key before their shuffle. The first runs
    on shards of each key, so that a key present in every input split does not
    send n rows from each of them to one task.
    """
    shard = F.pmod(F.xxhash64(tie), F.lit(shards)).alias("_shard")
    sharded = rows.select("*", shard)
    few = (
        sharded.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_shard").orderBy(*order)))
        .where(F.col("_rank") <= n)
        .drop("_rank", "_shard")
    )
    name = rank or "_rank"
    kept = few.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)
    return kept if rank else kept.drop(name)

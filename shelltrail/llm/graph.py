"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelltrail.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of `links` (a, b); links to itself and nulls are left out.

    Each round hangs the larger neighbours of a node, then its smaller ones, on the smallest: paths shrink to stars in
    about as many rounds as the longest path has binary digits. A round is a few aggregates with map-side partials and
    joins, and is written to the shared folder; the driver sees two numbers of it.
    """
    edges = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    seen = None
    while True:
        edges = written(edges, "components")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select("lo", "lo").distinct())
        seen = mark
        both = edges.union(edges.select("lo", "hi"))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("m", "hi").alias("m"))
        large = both.filter("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        down = large.join(least, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = down.union(least.select("hi", F.col("m").alias("lo"))).distinct()

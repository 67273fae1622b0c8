"""Bounded samples of labelled rows for fitting, and models as one broadcast value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelltrail.llm.common import written


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learned: Column, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """At most `rows` documents (doc_id, text, label) with a label of 0 or 1, `learned` rows only, picked by a hash of the id.

    Only ids and labels are ordered; the picked ids, `rows` at most, go to the scan of the texts. Of several labels of a
    document the highest counts.
    """
    named = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = named.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & learned).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(11))
    picked = known.orderBy(order, "doc_id").limit(rows)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return written(texts.join(F.broadcast(picked), "doc_id"), "fit-sample")


def first_per(frame: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` ids per key, by a hash of the id; the window is cut before its shuffle."""
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(11))
    place = F.row_number().over(Window.partitionBy(key).orderBy(order, "doc_id"))
    return frame.select("doc_id", key).withColumn("_place", place).filter(F.col("_place") <= rows).drop("_place")

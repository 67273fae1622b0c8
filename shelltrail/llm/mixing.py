"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelltrail.llm.common import FEWER_BYTES, shielded, text_steps, tidy, word_bytes, word_places, written
from shelltrail.plans.once import worked_out


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    # Only the first and last part can be empty.
    blank = F.when(parts[0] == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - blank).cast("long")


def source_sizes(docs: DataFrame, size: Column, source: str = "source") -> DataFrame:
    return docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))


def cycled_weights(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """`weights` in turn over the sources in code-point order, null last. One row per source is ordered here."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")))


def water_fill(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """`target` per source: shares by weight of all sizes, no source above `max_epochs` times its size.

    The level L solves sum(min(cap, weight * L)) = total. Sources in order of cap / weight reach their cap one after
    the other, so one running sum over the sources (not the documents) finds it: the level is the first one that does
    not lift the next source above its cap. Sources without words get 0. The orders break ties by source.
    """
    cap = F.col("source_size") * max_epochs
    order = [F.col("_ratio"), F.col("source").isNull(), F.col("source")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stepped = (
        sizes.withColumn("_ratio", cap / F.col("weight"))
        .withColumn("_place", F.row_number().over(Window.orderBy(*order)))
        .withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("_level", F.col("_left") / F.sum("weight").over(rest))
    )
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_place", "_level"))).over(everything)["_level"]
    filled = stepped.withColumn("_at", level).withColumn("_cap", cap.cast("double"))
    return filled.select(
        "source", "source_size", "weight", F.least("_cap", F.coalesce(F.col("weight") * F.col("_at"), "_cap")).alias("target")
    )


def mixing_targets(docs: DataFrame, max_epochs: int, weights: tuple[int, ...], text: str = "text", source: str = "source") -> DataFrame:
    """source, source_size, weight, target: one row per source, written, so that joins with it know its size."""
    sizes = source_sizes(docs, word_count(F.col(text)), source)
    return written(water_fill(cycled_weights(sizes, weights), max_epochs), "mixing-targets")


def _share(docs: DataFrame, targets: DataFrame, max_epochs: int, seed: int, doc_id: str, text: str, source: str) -> DataFrame:
    """`docs` with `_mix_size`, `_mix_source_size`, `_mix_target`, `_mix_taken`, `_mix_whole` and `_mix_part`."""
    renamed = targets.select(*[F.col(c).alias(f"_mix_{c}") for c in targets.columns])
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    size, of = F.col("_mix_size"), F.col("_mix_source_size")
    exact = F.when(of > 0, size * F.col("_mix_target") / of).otherwise(F.lit(0.0))
    whole = F.when(size > 0, F.floor(F.col("_mix_taken") / size)).otherwise(F.lit(0)).cast("long")
    # Words are counted once a row, whatever is filtered by their number later.
    sized = worked_out(docs, {"_mix_size": word_count(F.col(text))})
    return (
        sized.join(renamed, F.col(source).eqNullSafe(F.col("_mix_source")))
        .withColumn("_mix_taken", F.least(F.floor(exact + draw).cast("long"), size * max_epochs))
        .withColumn("_mix_whole", whole)
        .withColumn("_mix_part", F.col("_mix_taken") - F.col("_mix_whole") * size)
    )


def mixing_plan(
    docs: DataFrame,
    max_epochs: int = 3,
    weights: tuple[int, ...] = (1, 2, 3),
    seed: int = 7,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, whole and part per document.

    A document is taken rate = target / source_size times: `whole` full repetitions and `part` words of one more. The
    count rate * size is rounded up or down by a draw seeded with the id, so sums meet the targets and reruns agree.
    The sums combine on the map side; only one row per source is joined back, so texts and hot sources are not dealt.
    Null or blank texts have size 0 and take nothing; a null source is a source of its own; repeated ids draw alike.
    """
    targets = mixing_targets(docs, max_epochs, weights, text, source)
    shared = _share(docs.select(doc_id, text, source), targets, max_epochs, seed, doc_id, text, source)
    names = ("size", "source_size", "target", "taken", "whole", "part")
    return shared.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), *[F.col(f"_mix_{n}").alias(n) for n in names])


def first_words(batches):
    """Cuts `text` behind its `_mix_part`-th word, where `_mix_copy` says that this row is the fractional one."""
    inside = word_bytes()
    for batch in batches:
        names = batch.schema.names
        parts, copies = batch.column("_mix_part").to_pylist(), batch.column("_mix_copy").to_pylist()
        wholes = batch.column("_mix_whole").to_pylist()
        texts: list[str] = []
        for first, last, data, offsets in text_steps(batch.column("text"), FEWER_BYTES):
            _, ends, row = word_places(data, offsets, inside)
            begins = np.searchsorted(row, np.arange(last - first), "left")
            for i in range(last - first):
                j = first + i
                end = offsets[i + 1] if copies[j] <= wholes[j] else ends[begins[i] + parts[j] - 1]
                texts.append(data[offsets[i] : end].tobytes().decode())
        columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
        kept = [n for n in names if not n.startswith("_mix_")]
        yield pa.RecordBatch.from_arrays(columns, names=names).select(kept)


def mix(docs: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """The mixture as rows of `docs` (doc_id, text, source, any other columns): one row per whole repetition, and one
    with the first `part` words for a fractional one. A document that takes nothing has no row.
    """
    return shielded(docs, ("doc_id", "text", "source"), lambda inner: _mixed(inner, max_epochs, weights, seed))


def _mixed(docs: DataFrame, max_epochs: int, weights: tuple[int, ...], seed: int) -> DataFrame:
    targets = mixing_targets(docs, max_epochs, weights)
    shared = _share(docs, targets, max_epochs, seed, "doc_id", "text", "source")
    copies = F.col("_mix_whole") + F.when(F.col("_mix_part") > 0, 1).otherwise(0)
    repeated = shared.filter(copies > 0).withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    extra = [F.col(f"_mix_{n}") for n in ("copy", "whole", "part")]
    return repeated.select(*docs.columns, *extra).mapInArrow(tidy(first_words), docs.schema)

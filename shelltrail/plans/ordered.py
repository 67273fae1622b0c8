"""The previous or next row of an ordered history, without one task per history.

``lag`` over (host, user) puts a whole history into one task. One busy bot may
own a third of the log, so histories are cut into pieces of bounded size first:
by day; a crowded day at seconds, a crowded second at moments, a crowded moment
at ranges of the tie. Counts decide where the cuts fall, so a piece does not
grow with the log. The shuffle, the one sort and the one window run per piece;
the row at the open end of a piece gets what the piece before (or after) hands
over, which is one row per piece from an aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType


@dataclass(frozen=True)
class Cuts:
    """A piece holds about ``rows`` rows, less than three times as many as long as ties are spread evenly."""

    rows: int = 1_000_000


DEFAULT_CUTS = Cuts()


def _counted(rows: DataFrame, keys: dict[str, Column], unit: Column, tie: str, limit: int) -> DataFrame:
    """Per key and unit of time: its rows, the range of its ties, and the number of the stretch of ``limit`` rows it begins in."""
    units = rows.groupBy(*[column.alias(name) for name, column in keys.items()], unit.alias("_unit")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(tie).alias("_low"), F.max(tie).alias("_high")
    )
    before = Window.partitionBy(*keys).orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    return units.withColumn("_cut", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / limit))


def _same(pairs: list[tuple[Column, Column]]) -> Column:
    found = F.lit(True)
    for one, other in pairs:
        found = found & one.eqNullSafe(other)
    return found


def cut_into_pieces(rows: DataFrame, by: list[str], time: str, tie: str, cuts: Cuts = DEFAULT_CUTS) -> DataFrame:
    """Adds ``_day`` and ``_piece``: per key, consecutive stretches of (time, tie)."""
    limit = cuts.rows
    dated = rows.withColumn("_day", F.to_date(time)).withColumn("_second", F.unix_seconds(time)).withColumn("_moment", F.unix_micros(time))
    narrow = dated.select(*by, "_day", "_second", "_moment", tie)

    # Each level looks at what was crowded at the one before only; mostly that is nothing.
    day = [*by, "_day"]
    days = narrow.groupBy(*day).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    days = days.select(*[F.col(name).alias(f"_d{i}") for i, name in enumerate(day)])
    crowded = narrow.join(days, _same([(F.col(name), F.col(f"_d{i}")) for i, name in enumerate(day)]), "left_semi")
    seconds = _counted(crowded, {f"_s{i}": F.col(name) for i, name in enumerate(day)}, F.col("_second"), tie, limit)

    full = seconds.where(F.col("_n") > limit).select(*[f"_s{i}" for i in range(len(day))], "_unit")
    on_second = [*[(F.col(name), F.col(f"_s{i}")) for i, name in enumerate(day)], (F.col("_second"), F.col("_unit"))]
    inside = crowded.join(full, _same(on_second), "left_semi")
    moments = _counted(inside, {f"_m{i}": F.col(name) for i, name in enumerate([*day, "_second"])}, F.col("_moment"), tie, limit)

    seconds = seconds.select(*[f"_s{i}" for i in range(len(day))], F.col("_unit").alias("_s_unit"), F.col("_cut").alias("_s_cut"))
    names = [*day, "_second"]
    moments = moments.select(
        *[f"_m{i}" for i in range(len(names))],
        F.col("_unit").alias("_m_unit"),
        F.col("_cut").alias("_m_cut"),
        F.col("_n").alias("_m_n"),
        F.col("_low").alias("_m_low"),
        F.col("_high").alias("_m_high"),
    )
    joined = dated.join(
        seconds, _same([*[(F.col(name), F.col(f"_s{i}")) for i, name in enumerate(day)], (F.col("_second"), F.col("_s_unit"))]), "left"
    ).join(moments, _same([*[(F.col(name), F.col(f"_m{i}")) for i, name in enumerate(names)], (F.col("_moment"), F.col("_m_unit"))]), "left")
    part = F.lit(0)
    if isinstance(rows.schema[tie].dataType, IntegralType):
        # As doubles: the steps keep the order of the ties, whatever their range.
        span = F.col("_m_high").cast("double") - F.col("_m_low").cast("double") + 1
        place = (F.col(tie).cast("double") - F.col("_m_low").cast("double")) / span
        part = F.when(F.col("_m_n") > limit, F.floor(place * F.ceil(F.col("_m_n") / limit)))
    zero = F.lit(0).cast("long")
    cut = F.struct(
        F.coalesce("_s_cut", zero).alias("second"), F.coalesce("_m_cut", zero).alias("moment"), F.coalesce(part.cast("long"), zero).alias("tie")
    )
    return joined.select(*rows.columns, "_day", cut.alias("_piece"))


def with_neighbour(
    rows: DataFrame,
    by: list[str],
    time: str,
    tie: str,
    values: dict[str, Column],
    ahead: bool = False,
    cuts: Cuts = DEFAULT_CUTS,
) -> DataFrame:
    """Adds each of ``values`` (name -> expression) as seen on the previous row, or the next if ``ahead``."""
    key = [*by, "_day", "_piece"]
    seen = F.struct(*[value.alias(name) for name, value in values.items()])
    # One column for the key, so that null parts are equal and window and join agree on the shuffle.
    pieces = cut_into_pieces(rows, by, time, tie, cuts).withColumn("_key", F.struct(*key)).withColumn("_seen", seen)
    look, edge = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)

    place = F.struct(time, tie)
    ends = pieces.groupBy("_key").agg(edge("_seen", place).alias("_edge"))
    across = Window.partitionBy(*[F.col("_key")[name] for name in by]).orderBy(F.col("_key")["_day"], F.col("_key")["_piece"])
    handed = ends.select(F.col("_key").alias("_of"), look("_edge").over(across).alias("_handed"))

    within = Window.partitionBy("_key").orderBy(time, tie)
    linked = pieces.withColumn("_found", look("_seen").over(within))
    joined = linked.join(handed, F.col("_key") == F.col("_of"), "left")
    found = F.coalesce("_found", "_handed")
    return joined.select(*rows.columns, *[found[name].alias(name) for name in values])

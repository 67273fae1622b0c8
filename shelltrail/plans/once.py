"""Keeping expensive work from being done twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def worked_out(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds computed columns that everything after reads as they are.

    A filter on a computed column is usually moved below it with a copy of the
    expression, so that decoding or parsing runs again for every mention. A
    column that comes out of a generator is not copied.
    """
    made = F.struct(*[column.alias(name) for name, column in columns.items()])
    return rows.select("*", F.inline_outer(F.array(made)))

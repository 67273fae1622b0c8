"""Column expressions over raw JSON text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RFC3339 = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})\z"
ADDRESS = r"\A(\d{1,3}(\.\d{1,3}){3}|[0-9a-fA-F:]*:[0-9a-fA-F:.]*)\z"


def is_json_object(text: Column) -> Column:
    """Whether the whole text is one JSON object.

    The parser stops after the first value, so what follows is checked by
    putting the text inside a list and inside an object: no tail passes both.
    """
    listed = F.schema_of_variant(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    nested = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.coalesce(listed.startswith("ARRAY<OBJECT<") & nested.isNotNull(), F.lit(False))


def time_or_null(text: Column) -> Column:
    return text.try_cast("timestamp")


def strict_time(text: Column) -> Column:
    """RFC 3339, else null."""
    return F.when(text.rlike(RFC3339), text.try_cast("timestamp"))


def address_or_null(text: Column) -> Column:
    return F.when(text.rlike(ADDRESS), text)


def decode_base64(text: Column) -> Column:
    return F.try_to_binary(text, F.lit("base64")).cast("string")

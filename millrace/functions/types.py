"""Type names and schemas given by configuration."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import ParseException
from pyspark.sql import types as T

NAMED_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "integer": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
}


def resolve_type(name: str) -> T.DataType:
    """A type from its configured name (any case), or from a Spark DDL type such as ``decimal(12,2)``.

    Spark reads the DDL, so that form needs a running session.
    """
    text = name.strip()
    if text.lower() in NAMED_TYPES:
        return NAMED_TYPES[text.lower()]
    try:
        resolved = T.DataType.fromDDL(text)
    except ParseException as error:
        raise ValueError(f"unknown type name: {name!r}") from error
    # DDL reads "a int" as a one-field row; only an explicit struct<...> is a type here.
    if isinstance(resolved, T.StructType) and not text.lower().startswith("struct<"):
        raise ValueError(f"unknown type name: {name!r}")
    return resolved


def schema_from_config(fields: Mapping[str, str]) -> T.StructType:
    if not fields:
        raise ValueError("a schema needs at least one field")
    return T.StructType([T.StructField(name, resolve_type(kind)) for name, kind in fields.items()])

"""Extractor, transformer, mapper and validator hooks over rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def hooked(df: DataFrame, *hooks: tuple[Callable[[DataFrame], DataFrame], str | T.StructType]) -> DataFrame:
    """The result of DataFrame -> DataFrame hooks in order, each checked against the schema it declares."""
    for hook, schema in hooks:
        df = hook(df)
        wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        if df.schema.simpleString() != wanted.simpleString():
            raise TypeError(f"{hook.__name__} returned {df.schema.simpleString()}, not {wanted.simpleString()}")
    return df

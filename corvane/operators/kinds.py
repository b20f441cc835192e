"""Kinds of symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbols that get vectors; constants do too in TypeScript and JavaScript.
EMBEDDED = [
    "function", "async_function", "method", "constructor", "class", "partial_class", "struct", "interface",
    "enum", "record", "trait", "protocol", "object", "mixin", "extension", "union", "impl", "type", "module",
]

#: Symbols that can own others.
OWNERS = [
    "class", "partial_class", "sealed_class", "data_class", "struct", "interface", "trait", "impl", "record",
    "module", "namespace",
]

#: Kinds that a lookup by name shows first.
FIRST = ["function", "async_function", "method", "constructor", "class", "struct", "interface", "enum"]

#: Verbs of operations; a file that covers two that a query names ranks higher.
OPERATIONS = [
    "save", "load", "read", "write", "create", "update", "delete", "import", "export", "serialize",
    "deserialize", "parse", "persist", "apply", "restore",
]


def embeddable(symbols: DataFrame) -> DataFrame:
    """(kind, language) rows that get a vector."""
    script = (F.col("kind") == "constant") & F.col("language").isin("typescript", "javascript")
    return symbols.where(F.col("kind").isin(EMBEDDED) | script)


def lookup_order(kind: Column) -> Column:
    """0 for kinds that come first, 1 for the others."""
    return F.when(kind.isin(FIRST), 0).otherwise(1)


def simple_name(name: str) -> str:
    """A name without its qualifier."""
    for mark in ("::", "#", "."):
        name = name.rsplit(mark, 1)[-1]
    return name

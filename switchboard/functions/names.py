"""Name expressions. All are built-in column expressions, so they stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from switchboard.schema import UNKNOWN_NAME


def short_name(full_name: Column) -> Column:
    """Text after the last colon, then after its last dot; a name without a colon stays whole."""
    local = F.substring_index(F.substring_index(full_name, ":", -1), ".", -1)
    return F.when(F.contains(full_name, F.lit(":")), local).otherwise(full_name)


def name_contains(name: Column, query: str) -> Column:
    """Literal, case-insensitive containment; an empty query matches every name."""
    return F.contains(F.lower(name), F.lower(F.lit(query)))


def is_usable_name(name: Column) -> Column:
    """The written callee name can stand in for a callee that is not in the methods table."""
    return name.isNotNull() & ~name.isin("", UNKNOWN_NAME)

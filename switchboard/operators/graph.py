"""The call graph: two tables, and the keyed tables every query is built from.

``method_rows`` are the rows as read, in file order ``seq``; ``methods`` keeps the last row per
id; ``names`` maps short names to ids and is built from the raw rows, so an id that was defined
twice stays reachable under its old name.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchboard.functions.names import is_usable_name, short_name
from switchboard.operators.skew import count_rows, find_heavy_keys
from switchboard.schema import CALLS_FILE, METHODS_FILE, UNRESOLVED_ID
from switchboard.sources.tables import default_out_dir, read_calls, read_methods


def method_map(method_rows: DataFrame) -> DataFrame:
    """One row per method id, the last in file order.

    An aggregate rather than a window: repeats of an id collapse before the shuffle, and columns
    a query does not use are never shuffled.
    """
    last = [F.max_by(c, "seq").alias(c) for c in ("full_name", "signature", "file")]
    return method_rows.groupBy("method_id").agg(*last)


def name_index(method_rows: DataFrame) -> DataFrame:
    """Short name to method id, each pair once with its first position."""
    return (
        method_rows.select(short_name(F.col("full_name")).alias("fn"), "method_id", "seq")
        .groupBy("fn", "method_id")
        .agg(F.min("seq").alias("seq"))
    )


def in_edges(calls: DataFrame) -> DataFrame:
    """Distinct caller/callee pairs; repeated call sites collapse before any join."""
    return calls.select("callee_id", "caller_id").distinct()


def out_edges(calls: DataFrame) -> DataFrame:
    """Distinct caller/callee/written-name triples.

    An unresolved call without a usable written name can never appear in a result.
    """
    can_appear = (F.col("callee_id") != UNRESOLVED_ID) | is_usable_name(F.col("callee_full_name"))
    return calls.where(can_appear).select("caller_id", "callee_id", "callee_full_name").distinct()


class CallGraph:
    """Lazy keyed tables over one pair of method and call tables."""

    def __init__(
        self,
        method_rows: DataFrame,
        calls: DataFrame,
        out_dir: str | None = None,
    ):
        self.method_rows = method_rows
        self.calls = calls
        self.out_dir = out_dir
        # (fn, caller) and (fn, callee) of a stored graph, clustered by fn.
        self.callers_by_name: DataFrame | None = None
        self.callees_by_name: DataFrame | None = None
        # (part, fn) of a stored graph, clustered by part.
        self.name_parts: DataFrame | None = None

    @classmethod
    def from_csv(
        cls, spark: SparkSession, out_dir: str | None = None, multi_line: bool | None = None
    ) -> CallGraph:
        """``multi_line`` as for ``read_quoted_csv``."""
        out_dir = out_dir or default_out_dir()
        methods = read_methods(spark, out_dir, multi_line)
        return cls(methods, read_calls(spark, out_dir, multi_line), out_dir)

    @property
    def spark(self) -> SparkSession:
        return self.calls.sparkSession

    @property
    def files(self) -> dict[str, str | None]:
        """Where the two tables were read from, when that is known."""
        names = {"methods": METHODS_FILE, "calls": CALLS_FILE}
        return {t: self.out_dir and os.path.join(self.out_dir, f) for t, f in names.items()}

    @cached_property
    def methods(self) -> DataFrame:
        return method_map(self.method_rows)

    @cached_property
    def names(self) -> DataFrame:
        return name_index(self.method_rows)

    @cached_property
    def in_edges(self) -> DataFrame:
        return in_edges(self.calls)

    @cached_property
    def out_edges(self) -> DataFrame:
        return out_edges(self.calls)

    @cached_property
    def row_counts(self) -> list[int]:
        """Method rows and call rows."""
        return count_rows(self.method_rows, self.calls)

    @property
    def method_row_count(self) -> int:
        return self.row_counts[0]

    @property
    def call_count(self) -> int:
        return self.row_counts[1]

    def reaching_methods(self, calls: DataFrame, key: str) -> DataFrame:
        """The calls or edges, for a join of ``key`` with the method ids, without those that have
        no id there; they may be most of all rows, and all have one key. Usually no method has it."""
        return calls.where(F.col(key) != UNRESOLVED_ID) if self.none_is_unresolved else calls

    @cached_property
    def none_is_unresolved(self) -> bool:
        return self.method_rows.where(F.col("method_id") == UNRESOLVED_ID).isEmpty()

    @cached_property
    def heavy_callees(self) -> DataFrame | None:
        return find_heavy_keys(self.calls, "callee_id", self.call_count)

    @cached_property
    def heavy_callers(self) -> DataFrame | None:
        return find_heavy_keys(self.calls, "caller_id", self.call_count)

    @cached_property
    def heavy_method_ids(self) -> DataFrame | None:
        return find_heavy_keys(self.method_rows, "method_id", self.method_row_count)

    @cached_property
    def heavy_names(self) -> DataFrame | None:
        return find_heavy_keys(self.names, "fn", self.method_row_count)

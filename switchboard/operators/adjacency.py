"""Who calls a function, and what a function calls: for one name, many names or all names.

The two directions differ on purpose. A caller that has no row in the methods table is dropped;
a callee that has none survives under the name written at the call site.

A stored graph holds both directions as rows by name, clustered by name, so that a question about
one function is one pushed filter. Any other graph joins its edges, in one plan for all sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchboard.functions.names import is_usable_name
from switchboard.operators.graph import CallGraph
from switchboard.operators.skew import skew_join, stored
from switchboard.schema import UNRESOLVED_ID

# Copies of one call row that are expanded from one row.
COPIES_PER_ROW = 10_000


def callers_all(graph: CallGraph, names: DataFrame | None = None) -> DataFrame:
    """(fn, caller) for every name of ``names``, by default every name of the graph."""
    if names is None and graph.callers_by_name is not None:
        return graph.callers_by_name
    names = graph.names if names is None else names
    return caller_rows(graph, graph.in_edges, names).select("fn", "caller").distinct()


def caller_rows(graph: CallGraph, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(fn, <columns of edges>, caller) for distinct edges: a row per name of an edge's end."""
    named = skew_join(
        graph.reaching_methods(edges, "callee_id"),
        names.select("fn", "method_id"),
        on=("callee_id", "method_id"),
        spread=[c for c in edges.columns if c != "callee_id"],
        heavy=graph.heavy_callees,
        right_heavy=graph.heavy_method_ids,
        right_spread=["fn"],
    )
    # The other end stays in the row, so that rows differ and a heavy caller can be spread.
    callers = skew_join(
        named.select("fn", *edges.columns),
        graph.methods.select("method_id", "full_name"),
        on=("caller_id", "method_id"),
        spread=["fn", *(c for c in edges.columns if c != "caller_id")],
        heavy=graph.heavy_callers,
    )
    return callers.select("fn", *edges.columns, F.col("full_name").alias("caller"))


def callees_all(graph: CallGraph, names: DataFrame | None = None) -> DataFrame:
    """(fn, callee) for every name of ``names``, by default every name of the graph."""
    if names is None and graph.callees_by_name is not None:
        return graph.callees_by_name
    edges = graph.out_edges
    if names is not None:
        ids = names.select(F.col("method_id").alias("asked_id")).distinct()
        edges = skew_join(
            edges,
            ids,
            on=("caller_id", "asked_id"),
            spread=["callee_id", "callee_full_name"],
            how="left_semi",
            heavy=graph.heavy_callers,
        )
    names = graph.names if names is None else names
    # Edges are distinct, and few of a caller's lead to the same name: those meet at the end alone.
    return callee_rows(graph, edges, names).select("fn", "callee").distinct()


def callee_rows(graph: CallGraph, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(fn, <columns of edges>, callee) for distinct edges: a row per name of an edge's begin."""
    return _of_callers(graph, _callee_names(edges, graph.methods, graph.heavy_callees), names)


def _of_callers(graph: CallGraph, callees: DataFrame, names: DataFrame) -> DataFrame:
    return skew_join(
        callees,
        names.select("fn", "method_id"),
        on=("caller_id", "method_id"),
        spread=[c for c in callees.columns if c != "caller_id"],
        heavy=graph.heavy_callers,
        right_heavy=graph.heavy_method_ids,
        right_spread=["fn"],
    )


def _named_callees(edges: DataFrame, methods: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """Distinct (caller_id, callee) of distinct edges."""
    return _callee_names(edges, methods, heavy).select("caller_id", "callee").distinct()


def _callee_names(edges: DataFrame, methods: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """Distinct edges with the name of the callee, without those that have none; an unresolved
    call needs no method."""
    resolved = skew_join(
        edges.where(F.col("callee_id") != UNRESOLVED_ID),
        methods.select("method_id", "full_name"),
        on=("callee_id", "method_id"),
        spread=edges.columns,
        how="left",
        heavy=heavy,
    )
    known = F.col("method_id").isNotNull()
    callee = F.when(known, F.col("full_name")).otherwise(F.col("callee_full_name"))
    usable = is_usable_name(F.col("callee_full_name"))
    by_id = resolved.where(known | usable).select(*edges.columns, callee.alias("callee"))
    unresolved = edges.where((F.col("callee_id") == UNRESOLVED_ID) & usable)
    by_name = unresolved.select(*edges.columns, F.col("callee_full_name").alias("callee"))
    return by_id.unionByName(by_name)


def names_for(graph: CallGraph, requests: DataFrame) -> DataFrame:
    """The part of the name index that a table ``requests(function)`` asks for."""
    wanted = requests.select("function").distinct()
    found = skew_join(
        graph.names,
        wanted,
        on=("fn", "function"),
        spread=["method_id"],
        how="left_semi",
        heavy=graph.heavy_names,
    )
    return found.select("fn", "method_id", "seq")


def found_for(graph: CallGraph, requests: DataFrame, item: str) -> DataFrame:
    """(fn, <item>) for the requested names, ``item`` being caller or callee; written once, since
    results are used for their rows and for their counts."""
    by_name = graph.callers_by_name if item == "caller" else graph.callees_by_name
    if by_name is not None:
        wanted = requests.select("function").distinct()
        found = by_name.join(wanted, F.col("fn") == F.col("function"), "left_semi")
    else:
        find = callers_all if item == "caller" else callees_all
        found = find(graph, names_for(graph, requests))
    return stored(found, f"found-{item}")


def callers_for(graph: CallGraph, requests: DataFrame) -> DataFrame:
    """(function, caller) per request; one row with a null caller when there is none."""
    return _keep_requests(found_for(graph, requests, "caller"), "caller", requests)


def callees_for(graph: CallGraph, requests: DataFrame) -> DataFrame:
    """(function, callee) per request; one row with a null callee when there is none."""
    return _keep_requests(found_for(graph, requests, "callee"), "callee", requests)


def _keep_requests(found: DataFrame, item: str, requests: DataFrame) -> DataFrame:
    answered = found.select("fn").distinct()
    wanted = requests.select("function").distinct()
    without = wanted.join(answered, F.col("function") == F.col("fn"), "left_anti")
    nothing = F.lit(None).cast("string").alias(item)
    return found.withColumnRenamed("fn", "function").unionByName(without.select("function", nothing))


def callers_of(graph: CallGraph, function: str) -> DataFrame:
    """Full names of the callers of one function, ascending."""
    asked = F.col("fn") == function
    if graph.callers_by_name is not None:
        return graph.callers_by_name.where(asked).select("caller").orderBy("caller")
    ids = graph.names.where(asked).select("method_id").distinct()
    edges = graph.in_edges.join(ids, F.col("callee_id") == F.col("method_id"), "left_semi")
    callers = edges.select("caller_id").distinct()
    found = callers.join(graph.methods, F.col("caller_id") == F.col("method_id"))
    return found.select(F.col("full_name").alias("caller")).distinct().orderBy("caller")


def callees_of(graph: CallGraph, function: str) -> DataFrame:
    """Names of what one function calls, ascending."""
    asked = F.col("fn") == function
    if graph.callees_by_name is not None:
        return graph.callees_by_name.where(asked).select("callee").orderBy("callee")
    ids = graph.names.where(asked).select("method_id").distinct()
    edges = graph.out_edges.join(ids, F.col("caller_id") == F.col("method_id"), "left_semi")
    # These are the edges of one function: no callee holds more of them than it has ids.
    found = _named_callees(edges, graph.methods, None)
    return found.select("callee").distinct().orderBy("callee")


def calls_with_caller(graph: CallGraph) -> DataFrame:
    """Raw method rows merged with the call rows they make; all columns of both."""
    return _merge(graph, "caller_id", graph.heavy_callers)


def calls_with_callee(graph: CallGraph) -> DataFrame:
    """Raw method rows merged with the call rows that reach them; all columns of both."""
    return _merge(graph, "callee_id", graph.heavy_callees)


def _merge(graph: CallGraph, key: str, heavy: DataFrame | None) -> DataFrame:
    """Call rows may be exact copies of each other, which no hash of theirs could separate. Those
    of heavy keys become (row, copies), are joined, and are expanded again."""
    rows, calls = graph.method_rows, graph.reaching_methods(graph.calls, key)
    columns = [*(c for c in rows.columns if c != "seq"), *calls.columns]
    on = F.col(key) == F.col("method_id")
    if heavy is None:
        return calls.join(rows, on).select(*columns)
    is_heavy = F.col(key) == F.col("heavy_key")
    usual = calls.join(heavy, is_heavy, "left_anti").join(rows, on)
    copies = calls.join(heavy, is_heavy, "left_semi").groupBy(*calls.columns)
    parts = F.ceil(F.col("copies") / COPIES_PER_ROW).cast("int")
    collapsed = copies.agg(F.count("*").alias("copies")).withColumn(
        "part", F.explode(F.sequence(F.lit(1), parts))
    )
    merged = skew_join(
        collapsed,
        rows,
        on=(key, "method_id"),
        spread=[*calls.columns, "part"],
        heavy=heavy,
        right_heavy=graph.heavy_method_ids,
        right_spread=["seq"],
    )
    before = (F.col("part") - 1) * COPIES_PER_ROW
    in_part = F.least(F.lit(COPIES_PER_ROW), F.col("copies") - before).cast("int")
    expanded = merged.withColumn("copy", F.explode(F.sequence(F.lit(1), in_part)))
    return usual.select(*columns).unionByName(expanded.select(*columns))

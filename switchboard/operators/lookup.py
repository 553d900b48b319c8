"""Function details, name search and graph totals.

A stored graph has an index of name parts: for each run of one, two or three characters the names
that hold it. A search reads the names listed under all runs of its text, which are few row groups,
and looks at those only. A text shorter than a run is a run itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchboard.functions.names import name_contains
from switchboard.operators.adjacency import names_for
from switchboard.operators.graph import CallGraph
from switchboard.operators.skew import find_heavy_keys, skew_join
from switchboard.sources.tables import path_exists

# The longest run of characters in the index of name parts.
LONGEST_PART = 3
DETAIL_COLUMNS = ["method_id", "full_name", "signature", "file"]


def details_all(graph: CallGraph, names: DataFrame | None = None) -> DataFrame:
    """(fn, method_id, full_name, signature, file): the first id under each name, with the
    content of the last row of that id."""
    names = graph.names if names is None else names
    first = names.groupBy("fn").agg(F.min_by("method_id", "seq").alias("first_id"))
    found = skew_join(
        first,
        graph.methods,
        on=("first_id", "method_id"),
        spread=["fn"],
        heavy=graph.heavy_method_ids,
    )
    return found.select("fn", *DETAIL_COLUMNS)


def details_for(graph: CallGraph, requests: DataFrame) -> DataFrame:
    """Details per requested function, all null when the name is unknown."""
    wanted = requests.select("function").distinct()
    found = details_all(graph, names_for(graph, requests))
    return wanted.join(found, F.col("function") == F.col("fn"), "left").drop("fn")


def function_details(graph: CallGraph, function: str) -> DataFrame:
    """At most one row; empty when the name is unknown."""
    names = graph.names.where(F.col("fn") == function)
    first_id = names.agg(F.min_by("method_id", "seq")).first()[0]
    # A single id is looked up by value, which reaches the scan as a filter.
    found = graph.methods.where(F.col("method_id") == F.lit(first_id).cast("string"))
    return found.select(*DETAIL_COLUMNS)


def name_parts(names: DataFrame) -> DataFrame:
    """(part, fn): the names that hold each run of up to ``LONGEST_PART`` characters."""
    low = names.select("fn").distinct().withColumn("low", F.lower("fn"))
    runs = [_runs(F.col("low"), F.lit(size)) for size in range(1, LONGEST_PART + 1)]
    return low.select(F.explode(F.array_distinct(F.concat(*runs))).alias("part"), "fn")


def _runs(text: Column, size: Column) -> Column:
    """All runs of ``size`` characters, in order; none where the text is shorter."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    found = F.transform(starts, lambda at: F.substring(text, at, size))
    return F.coalesce(found, F.array().cast("array<string>"))


def _asked_runs(query: Column) -> Column:
    low = F.lower(query)
    return F.array_distinct(_runs(low, F.least(F.lit(LONGEST_PART), F.length(low))))


def search_functions(graph: CallGraph, query: str) -> DataFrame:
    """Distinct short names that contain ``query``, ascending."""
    contains = name_contains(F.col("fn"), query)
    if graph.name_parts is None or not query:
        return graph.names.where(contains).select("fn").distinct().orderBy("fn")
    (asked,) = graph.spark.range(1).select(_asked_runs(F.lit(query))).first()
    listed = graph.name_parts.where(F.col("part").isin(asked))
    # A name is listed once under each part.
    holds_all = listed.groupBy("fn").agg(F.count("*").alias("n")).where(F.col("n") == len(asked))
    return holds_all.where(contains).select("fn").orderBy("fn")


def search_for(graph: CallGraph, requests: DataFrame) -> DataFrame:
    """(query, fn): the short names that contain each requested text. A text without a match gives
    no row, and a null one is no text.

    Each text is compared with the names under its rarest part only.
    """
    parts = name_parts(graph.names) if graph.name_parts is None else graph.name_parts
    asked = requests.select("query").where("query is not null").distinct()
    sizes = parts.groupBy(F.col("part").alias("counted")).agg(F.count("*").alias("n"))
    looked_up = asked.select("query", F.explode(_asked_runs(F.col("query"))).alias("wanted"))
    sized = looked_up.join(sizes, F.col("wanted") == F.col("counted"), "left")
    rarest = sized.groupBy("query").agg(
        F.min_by("wanted", F.struct(F.coalesce("n", F.lit(0)), "wanted")).alias("wanted")
    )
    met = skew_join(
        rarest,
        parts,
        on=("wanted", "part"),
        spread=["query"],
        heavy=find_heavy_keys(rarest, "wanted"),
        right_heavy=find_heavy_keys(parts, "part"),
        right_spread=["fn"],
    )
    found = met.where(F.lower("fn").contains(F.lower("query"))).select("query", "fn")
    # Every name contains the empty text, of which there is one row at most.
    empty = F.broadcast(asked.where("query = ''").limit(1))
    everything = graph.names.select("fn").where("fn is not null").distinct()
    everything = everything.withColumn("query", F.lit(""))
    return found.unionByName(everything.join(empty, "query").select("query", "fn"))


def graph_totals(graph: CallGraph) -> DataFrame:
    """One row: distinct method ids, call rows, distinct short names."""
    totals = {
        "total_methods": graph.methods.agg(F.count("*")),
        "total_calls": graph.calls.agg(F.count("*")),
        "unique_functions": graph.names.select("fn").distinct().agg(F.count("*")),
    }
    one_row = graph.spark.range(1)
    return one_row.select(*[total.scalar().alias(name) for name, total in totals.items()])


def graph_stats(graph: CallGraph) -> DataFrame:
    """The totals with the two source files and whether they exist now."""
    files = graph.files
    paths = [F.lit(path).cast("string").alias(f"{t}_file") for t, path in files.items()]
    loaded = [
        F.lit(bool(path) and path_exists(graph.spark, path)).alias(f"{t}_loaded")
        for t, path in files.items()
    ]
    return graph_totals(graph).select("*", *paths, *loaded)

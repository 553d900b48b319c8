"""JSON results of the five questions.

Details and totals are one small object per row. Lists have no size bound, so a list result is
never built inside one row: it is a table of text lines that together, in the order of
(function, section, item), are the indented JSON document. Written with a text writer, a list of
any length is produced by all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchboard.operators.adjacency import callees_of, callers_of, found_for
from switchboard.operators.graph import CallGraph
from switchboard.operators.lookup import (
    details_for,
    function_details,
    graph_stats,
    search_functions,
)
from switchboard.operators.skew import stored

HEAD, ITEM, TAIL = 0, 1, 2
# Fixed value of the answer to a question about an unknown function.
NOT_FOUND = "Function not found"


def json_string(text: Column) -> Column:
    """The JSON literal of a string, quotes included."""
    in_array = F.to_json(F.array(text))
    return F.substring(in_array, F.lit(2), F.length(in_array) - 2)


def _documents(
    found: DataFrame, requests: DataFrame, item: str, asked: str, listed: str
) -> DataFrame:
    """Lines of one document per request, from a written table ``found(fn, <item>)``.

    The ends of the lists are written too: the join of two written tables is one whose heavy
    names adaptive execution can split.
    """
    ends = found.groupBy(F.col("fn").alias("end_fn")).agg(
        F.count("*").alias("n"), F.max(item).alias("last_item")
    )
    ends = stored(ends, "list-ends")
    items = found.join(ends, F.col("fn") == F.col("end_fn")).withColumnRenamed("fn", "function")
    wanted = requests.select("function").distinct()
    counted = wanted.join(ends, F.col("function") == F.col("end_fn"), "left")
    counts = counted.select("function", F.coalesce("n", F.lit(0)).alias("count"))
    return _lines(items, counts, item, asked, listed)


def _document(found: DataFrame, argument: str, item: str, asked: str, listed: str) -> DataFrame:
    """Lines of the document of one question, from ``found(<item>)``."""
    function = F.lit(argument).alias("function")
    last_item = found.agg(F.max(item)).scalar().alias("last_item")
    count = found.agg(F.count("*")).scalar().alias("count")
    items = found.select(function, item, last_item)
    counts = found.sparkSession.range(1).select(function, count)
    return _lines(items, counts, item, asked, listed)


def _lines(
    items: DataFrame, counts: DataFrame, item: str, asked: str, listed: str
) -> DataFrame:
    """From ``items(function, <item>, last_item)`` and ``counts(function, count)``."""
    comma = F.when(F.col(item) < F.col("last_item"), ",").otherwise("")
    item_lines = items.select(
        "function",
        F.lit(ITEM).alias("section"),
        F.col(item).alias("item"),
        F.concat(F.lit("    "), json_string(F.col(item)), comma).alias("text"),
    )

    question = json_string(F.col("function"))
    head = F.concat(F.lit(f'{{\n  "{asked}": '), question, F.lit(f',\n  "{listed}": ['))
    head_text = F.when(F.col("count") == 0, F.concat(head, F.lit("],"))).otherwise(head)
    totals = F.concat(F.lit('  "count": '), F.col("count"), F.lit(',\n  "success": true\n}'))
    tail_text = F.when(F.col("count") == 0, totals).otherwise(F.concat(F.lit("  ],\n"), totals))
    frame = counts.select(
        "function",
        F.explode(
            F.array(
                F.struct(F.lit(HEAD).alias("section"), head_text.alias("text")),
                F.struct(F.lit(TAIL).alias("section"), tail_text.alias("text")),
            )
        ).alias("line"),
    )
    frame_lines = frame.select(
        "function",
        F.col("line.section").alias("section"),
        F.lit("").alias("item"),
        F.col("line.text").alias("text"),
    )
    return item_lines.unionByName(frame_lines)


def callers_json(graph: CallGraph, requests: DataFrame) -> DataFrame:
    found = found_for(graph, requests, "caller")
    return _documents(found, requests, "caller", "function", "callers")


def callees_json(graph: CallGraph, requests: DataFrame) -> DataFrame:
    found = found_for(graph, requests, "callee")
    return _documents(found, requests, "callee", "function", "callees")


def search_json(graph: CallGraph, query: str) -> DataFrame:
    found = search_functions(graph, query)
    return _document(found, query, "fn", "query", "results")


def details_json(graph: CallGraph, requests: DataFrame) -> DataFrame:
    """(function, json), one object per request."""
    return _details_objects(details_for(graph, requests))


def _details_objects(rows: DataFrame) -> DataFrame:
    known = F.col("method_id").isNotNull()
    details = F.struct("method_id", "full_name", "signature", "file")
    found = F.struct(
        "function", details.alias("details"), F.lit(True).alias("success")
    )
    missing = F.struct(
        "function",
        F.when(F.lit(False), details).alias("details"),
        F.lit(False).alias("success"),
        F.lit(NOT_FOUND).alias("error"),
    )
    text = F.when(known, _to_json(found)).otherwise(_to_json(missing))
    return rows.select("function", text.alias("json"))


def stats_json(graph: CallGraph) -> DataFrame:
    stats = graph_stats(graph).withColumn("success", F.lit(True))
    return stats.select(_to_json(F.struct(*stats.columns)).alias("json"))


def _to_json(struct: Column) -> Column:
    return F.to_json(struct, {"ignoreNullFields": "false"})


def answer(graph: Callable[[], CallGraph], question: str, argument: str | None = None) -> DataFrame:
    """The lines of one answer, in order, as a single column ``text``.

    ``graph`` is called here, so that a graph that cannot be opened gives a failure document
    like any other failed question. Errors while Spark runs the answer are raised by the action.
    """
    asked, empty = ANSWER_SHAPES[question]
    try:
        return _answer(graph(), question, argument)
    except Exception as error:  # the caller gets the reason as a document
        fields = {asked: argument, **empty} if asked else {}
        failure = {**fields, "success": False, "error": str(error)}
        row = SparkSession.active().range(1).select(
            *[F.lit(value).alias(field) for field, value in failure.items()]
        )
        return row.select(_to_json(F.struct(*row.columns)).alias("text"))


# Fixed values, per question: the field that repeats the argument, and those of an empty answer.
ANSWER_SHAPES = {
    "get_callees": ("function", {"callees": []}),
    "get_callers": ("function", {"callers": []}),
    "get_function_details": ("function", {"details": None}),
    "search_functions": ("query", {"results": []}),
    "get_call_graph_stats": (None, {}),
}


def _answer(graph: CallGraph, question: str, argument: str | None) -> DataFrame:
    order = ["function", "section", "item"]
    if question == "get_call_graph_stats":
        return stats_json(graph).withColumnRenamed("json", "text")
    if question == "search_functions":
        return search_json(graph, argument).orderBy(*order).select("text")
    if question == "get_function_details":
        details = function_details(graph, argument)
        if details.isEmpty():
            nothing = [F.lit(None).cast("string").alias(c) for c in details.columns]
            details = graph.spark.range(1).select(*nothing)
        rows = details.withColumn("function", F.lit(argument))
        return _details_objects(rows).select(F.col("json").alias("text"))
    find, item = (callers_of, "caller") if question == "get_callers" else (callees_of, "callee")
    lines = _document(find(graph, argument), argument, item, "function", f"{item}s")
    return lines.orderBy(*order).select("text")

"""Properties of physical plans that matter at scale."""

import re

import pytest

from __spark_entry__ import queries
from switchboard.operators import adjacency, lookup
from switchboard.plans import envelope, fixtures
from switchboard.sources import snapshot

SF_DIR = "/root/testdata/sf0.001"
QUERIES = [
    *("callers_all", "callees_all", "callers_for", "callers_json", "details_all"),
    *("resolve_calls", "calls_with_caller", "analyze", "compare", "graph_stats", "abs_path"),
    "search_json",
]


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_no_pairing_of_everything_and_no_python(spark, name):
    text = plan(queries()[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "NestedLoop", "EvalPython", "MapInArrow", "Window"):
        assert operator not in text, operator


def test_no_pairing_of_everything_with_heavy_keys(small_tasks):
    for name in ("callers_all", "callees_all", "resolve_calls", "analyze", "calls_with_callee"):
        text = plan(queries()[name](small_tasks, SF_DIR))
        assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize(
    "question", ["get_callers", "get_callees", "search_functions", "get_function_details"]
)
def test_no_pairing_of_everything_in_a_single_answer(spark, question):
    graph = fixtures.graph(spark, SF_DIR)
    text = plan(envelope.answer(lambda: graph, question, "n15"))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_scans_read_only_what_is_used(spark):
    graph = fixtures.graph(spark, SF_DIR)
    text = plan(lookup.search_functions(graph, "x"))
    assert "lineitem" not in text
    read = set(re.findall(r"ReadSchema: struct<([^>]*)", plan(adjacency.callers_all(graph))))
    columns = {c.split(":")[0] for schema in read for c in schema.split(",")}
    assert not columns & {"l_quantity", "l_shipdate", "l_extendedprice", "p_brand", "p_retailprice"}


def test_repeated_calls_collapse_before_the_joins(spark):
    text = plan(adjacency.callers_all(fixtures.graph(spark, SF_DIR)))
    # Read from the scan up: a partial aggregate, its exchange and the final one, then the join.
    below = text[: text.index("lineitem.parquet")]
    assert re.search(
        r"Join.*HashAggregate\(keys=\[callee_id.*Exchange hashpartitioning\(callee_id[^,]*, "
        r"caller_id.*HashAggregate\(keys=\[callee_id",
        below,
        re.DOTALL,
    )


def test_stored_graph_is_searched_with_pushed_filters(small_tasks, tmp_path):
    """One filter on the name, also where every key would count as heavy, and no job before."""
    spark = small_tasks
    snapshot.save(fixtures.graph(spark, SF_DIR), str(tmp_path))
    graph = snapshot.open_snapshot(spark, str(tmp_path))
    group = "stored-questions"
    spark.sparkContext.setJobGroup(group, group)
    asked = {
        "callers_by_name": adjacency.callers_of(graph, "n15"),
        "callees_by_name": adjacency.callees_of(graph, "n15"),
    }
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    for table, rows in asked.items():
        text = plan(rows)
        assert all(f"/{table}/" in file for file in rows.inputFiles())
        assert "EqualTo(fn,n15)" in text and "Join" not in text
    details = lookup.function_details(graph, "n15")._jdf.queryExecution().toString()
    assert "EqualTo(method_id" in details


def test_requests_read_the_calls_once(spark):
    graph = fixtures.graph(spark, SF_DIR)
    rows = adjacency.callers_for(graph, fixtures.requests(spark, SF_DIR))
    assert "lineitem" not in plan(rows)  # what was found is read from where it was written

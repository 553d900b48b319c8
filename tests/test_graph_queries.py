"""Queries on a small graph with answers listed by hand, and against SQL on random graphs with
every special case."""

import json
import random
import re

import duckdb
import pytest

from switchboard.operators import adjacency, graph as keyed, lookup, skew
from switchboard.operators.graph import CallGraph
from switchboard.plans import envelope
from switchboard.plans.oracle import CALLEES, CALLERS, DETAILS, METHODS, NAMES
from switchboard.schema import CALL_COLUMNS
from switchboard.sources import snapshot
from switchboard.sources.tables import write_calls, write_methods

METHOD_SCHEMA = "seq bigint, method_id string, full_name string, signature string, file string"
CALL_SCHEMA = ", ".join(f"{c} string" for c in CALL_COLUMNS)


class Expected:
    """The answers by SQL in another engine, over the same rows."""

    def __init__(self, methods, calls):
        sql = duckdb.connect()
        sql.execute(
            "create table method_rows (seq bigint, method_id varchar, full_name varchar, "
            "signature varchar, file varchar)"
        )
        sql.execute(f"create table calls ({', '.join(f'{c} varchar' for c in CALL_COLUMNS)})")
        sql.executemany("insert into method_rows values (?, ?, ?, ?, ?)", methods)
        if calls:
            sql.executemany(f"insert into calls values ({', '.join('?' * 8)})", calls)

        def ask(query, *relations):
            return sql.sql(f"with {', '.join([METHODS, NAMES, *relations])} {query}").fetchall()

        listed = "select fn, list({0} order by {0}) from {0}s group by fn"
        self.caller_lists = dict(ask(listed.format("caller"), CALLERS))
        self.callee_lists = dict(ask(listed.format("callee"), CALLEES))
        self.rows = {row[0]: row[1:] for row in ask("select * from details", DETAILS)}
        self.names = {name for (name,) in ask("select distinct fn from names")}
        (self.n_methods,) = ask("select count(*) from methods")[0]

    def callers(self, name):
        return self.caller_lists.get(name, [])

    def callees(self, name):
        return self.callee_lists.get(name, [])

    def details(self, name):
        return self.rows.get(name)

    def search(self, query):
        return sorted(n for n in self.names if query.lower() in n.lower())


def random_graph(seed, hub_share=0.35):
    """A third of the calls reach one hub, a third leave one module, a third are unresolved, and
    one id is defined again and again under new names."""
    rng = random.Random(seed)
    methods, calls = [], []
    for seq in range(120):
        method_id = "9" if rng.random() < hub_share else str(rng.randrange(60))
        name = rng.choice(
            [f"a/f{rng.randrange(9)}.py:<module>.C.m{rng.randrange(40)}", "os.path.join",
             f"b.py:g{rng.randrange(9)}", "b.py:<module>", "odd:", "lib.x"]
        )
        methods.append((seq, method_id, name, rng.choice(["", "def()"]), "f.py"))
    if seed % 2:
        methods.append((120, "-1", "c.py:<module>.minus", "", ""))
    for _ in range(900):
        caller = "9" if rng.random() < hub_share else str(rng.randrange(80))
        kind = rng.random()
        callee = "-1" if kind < 0.33 else "3" if kind < 0.66 else str(rng.randrange(80))
        name = rng.choice(["", "<unknownFullName>", f"ext.e{rng.randrange(50)}", "z.py:<module>.q"])
        calls.append((caller, "x", "f", callee, name, "f", "s", str(rng.randrange(9))))
    return methods, calls


def frames(spark, methods, calls):
    return CallGraph(
        spark.createDataFrame(methods, METHOD_SCHEMA).repartition(3),
        spark.createDataFrame(calls, CALL_SCHEMA).repartition(3),
    )


def grouped(rows):
    found = {}
    for name, item in rows.collect():
        found.setdefault(name, []).append(item)
    return {name: sorted(items) for name, items in found.items()}


def check_all(graph, methods, calls):
    expected = Expected(methods, calls)
    names = expected.names
    assert grouped(adjacency.callers_all(graph)) == {
        n: expected.callers(n) for n in names if expected.callers(n)
    }
    assert grouped(adjacency.callees_all(graph)) == {
        n: expected.callees(n) for n in names if expected.callees(n)
    }
    details = {r[0]: tuple(r)[1:] for r in lookup.details_all(graph).collect()}
    assert details == {n: expected.details(n) for n in names}
    totals = lookup.graph_totals(graph).first()
    assert tuple(totals) == (expected.n_methods, len(calls), len(names))


@pytest.mark.parametrize(("seed", "rows_per_task"), [(1, "1000000"), (2, "100"), (3, "1")])
def test_all_names(spark, seed, rows_per_task):
    methods, calls = random_graph(seed)
    spark.conf.set("spark.switchboard.rowsPerTask", rows_per_task)
    try:
        check_all(frames(spark, methods, calls), methods, calls)
    finally:
        spark.conf.unset("spark.switchboard.rowsPerTask")


def test_heavy_keys_are_found(small_tasks):
    graph = frames(small_tasks, *random_graph(1))
    assert {r.heavy_key for r in graph.heavy_callees.collect()} >= {"3", "-1"}
    assert "9" in {r.heavy_key for r in graph.heavy_callers.collect()}
    assert "9" in {r.heavy_key for r in graph.heavy_method_ids.collect()}


SMALL_METHODS = [
    (0, "1", "app.py:<module>.main", "main()", "app.py"),
    (1, "2", "app.py:<module>.Box.load", "load(self)", "app.py"),
    (2, "3", "lib.py:<module>.load", "load(x)", "lib.py"),
    (3, "2", "app.py:<module>.Box.reload", "", "app.py"),
    (4, "4", "os.path.join", "", "<unknown>"),
]
SMALL_CALLS = [
    ("1", "", "", "2", "stale", "", "", "3"),
    ("1", "", "", "2", "stale", "", "", "4"),
    ("1", "", "", "3", "", "", "", "5"),
    ("2", "", "", "2", "", "", "", "9"),
    ("2", "", "", "-1", "print", "", "", "10"),
    ("2", "", "", "-1", "<unknownFullName>", "", "", "11"),
    ("2", "", "", "77", "gone.py:f", "", "", "12"),
    ("88", "", "", "3", "", "", "", "1"),
]


@pytest.mark.parametrize("stored", [False, True])
def test_answers_listed_by_hand(spark, tmp_path, stored):
    graph = frames(spark, SMALL_METHODS, SMALL_CALLS)
    if stored:
        snapshot.save(graph, str(tmp_path))
        graph = snapshot.open_snapshot(spark, str(tmp_path))
    main, reload, load = (f"{m}:<module>.{n}" for m, n in (
        ("app.py", "main"), ("app.py", "Box.reload"), ("lib.py", "load")))
    assert grouped(adjacency.callers_all(graph)) == {
        "load": [reload, main],  # id 2 stays reachable under its old name; id 88 has no row
        "reload": [reload, main],
    }
    assert grouped(adjacency.callees_all(graph)) == {
        "main": [reload, load],
        "load": [reload, "gone.py:f", "print"],
        "reload": [reload, "gone.py:f", "print"],
    }
    assert [r.callee for r in adjacency.callees_of(graph, "load").collect()] == [
        reload, "gone.py:f", "print"
    ]
    assert [r.caller for r in adjacency.callers_of(graph, "load").collect()] == [reload, main]
    assert [tuple(r) for r in lookup.function_details(graph, "load").collect()] == [
        ("2", reload, "", "app.py")
    ]
    found = [r.fn for r in lookup.search_functions(graph, "LOAD").collect()]
    assert found == ["load", "reload"]
    assert tuple(lookup.graph_totals(graph).first()) == (4, 8, 4)


@pytest.mark.parametrize("stored", [False, True])
def test_single_names(spark, tmp_path, stored):
    methods, calls = random_graph(3)
    graph, expected = frames(spark, methods, calls), Expected(methods, calls)
    if stored:
        snapshot.save(graph, str(tmp_path))
        graph = snapshot.open_snapshot(spark, str(tmp_path))
    for name in ["<module>", "minus", "no such name"]:
        callers = [r.caller for r in adjacency.callers_of(graph, name).collect()]
        assert callers == expected.callers(name)
        callees = [r.callee for r in adjacency.callees_of(graph, name).collect()]
        assert callees == expected.callees(name)
        details = [tuple(r) for r in lookup.function_details(graph, name).collect()]
        assert details == ([expected.details(name)] if expected.details(name) else [])


def test_requests_keep_names_without_result(small_tasks):
    methods, calls = random_graph(2)
    graph, expected = frames(small_tasks, methods, calls), Expected(methods, calls)
    asked = ["m1", "m2", "m2", "<module>", "lib.x", "nowhere"]
    requests = small_tasks.createDataFrame([(a,) for a in asked], "function string")
    assert grouped(adjacency.callers_for(graph, requests).fillna("(none)")) == {
        a: expected.callers(a) or ["(none)"] for a in set(asked)
    }
    assert grouped(adjacency.callees_for(graph, requests).fillna("(none)")) == {
        a: expected.callees(a) or ["(none)"] for a in set(asked)
    }
    details = {r.function: tuple(r)[1:] for r in lookup.details_for(graph, requests).collect()}
    assert details == {a: expected.details(a) or (None,) * 4 for a in set(asked)}


def test_merges_keep_repeated_ids_and_calls(small_tasks):
    methods, calls = random_graph(4)
    graph = frames(small_tasks, methods, calls)
    for rows, end in (
        (adjacency.calls_with_caller(graph), 0),
        (adjacency.calls_with_callee(graph), 3),
    ):
        expected = sorted(m[1:] + c for m in methods for c in calls if m[1] == c[end])
        assert sorted(tuple(r) for r in rows.collect()) == expected


def test_search(spark):
    methods, calls = random_graph(5)
    graph, expected = frames(spark, methods, calls), Expected(methods, calls)
    for query in ["", "M1", "<MOD", "."]:
        found = [r.fn for r in lookup.search_functions(graph, query).collect()]
        assert found == expected.search(query)


def test_name_index_keeps_the_old_name_of_a_redefined_id(spark):
    rows = spark.createDataFrame(
        [(0, "1", "a.py:old", "", ""), (1, "1", "a.py:new", "s", "f"), (2, "2", "b:old", "", "")],
        METHOD_SCHEMA,
    )
    graph = CallGraph(rows, spark.createDataFrame([], CALL_SCHEMA))
    index = {(r.fn, r.method_id, r.seq) for r in keyed.name_index(rows).collect()}
    assert index == {("old", "1", 0), ("new", "1", 1), ("old", "2", 2)}
    assert [tuple(r) for r in lookup.function_details(graph, "old").collect()] == [
        ("1", "a.py:new", "s", "f")
    ]


# Result documents


def document(graph, question, argument=None):
    lines = envelope.answer(lambda: graph, question, argument).collect()
    return "\n".join(r.text for r in lines)


@pytest.mark.parametrize("name", ["m1", "<module>", "", "nowhere", 'quo"te\\é'])
def test_list_documents(small_tasks, name):
    methods, calls = random_graph(7)
    methods.append((500, "77", 'a.py:quo"te\\é', "", ""))
    calls.append(("77", "", "", "-1", 'x"y\\zé\n', "", "", "1"))
    graph, expected = frames(small_tasks, methods, calls), Expected(methods, calls)
    for question, field, answer in (
        ("get_callers", "callers", expected.callers(name)),
        ("get_callees", "callees", expected.callees(name)),
    ):
        text = document(graph, question, name)
        shape = {"function": name, field: answer, "count": len(answer), "success": True}
        assert json.loads(text) == shape
        assert text == json.dumps(shape, indent=2, ensure_ascii=False)


def test_search_document(spark):
    methods, calls = random_graph(7)
    graph, expected = frames(spark, methods, calls), Expected(methods, calls)
    for query in ("M1", "zzz"):
        found = expected.search(query)
        shape = {"query": query, "results": found, "count": len(found), "success": True}
        assert document(graph, "search_functions", query) == json.dumps(shape, indent=2)


def test_details_documents(spark):
    methods, calls = random_graph(7)
    graph, expected = frames(spark, methods, calls), Expected(methods, calls)
    fields = ("method_id", "full_name", "signature", "file")
    known = min(expected.names)
    assert json.loads(document(graph, "get_function_details", known)) == {
        "function": known,
        "details": dict(zip(fields, expected.details(known), strict=True)),
        "success": True,
    }
    unknown = json.loads(document(graph, "get_function_details", "nowhere"))
    assert unknown == {
        "function": "nowhere",
        "details": None,
        "success": False,
        "error": "Function not found",
    }


def test_failure_documents(spark, tmp_path):
    def missing():
        return CallGraph.from_csv(spark, str(tmp_path))

    for question, fields in (
        ("get_callers", {"function": "f", "callers": []}),
        ("get_callees", {"function": "f", "callees": []}),
        ("get_function_details", {"function": "f", "details": None}),
        ("search_functions", {"query": "f", "results": []}),
        ("get_call_graph_stats", {}),
    ):
        failed = json.loads(envelope.answer(missing, question, "f").first().text)
        assert "methods.csv" in failed.pop("error")
        assert failed == {**fields, "success": False}
        assert list(failed)[0] == next(iter(fields), "success")


def test_stats_document(spark, tmp_path):
    methods, calls = random_graph(6)
    out_dir = str(tmp_path / "out")
    write_methods(spark.createDataFrame(methods, METHOD_SCHEMA), out_dir)
    write_calls(spark.createDataFrame(calls, CALL_SCHEMA), out_dir)
    graph, expected = CallGraph.from_csv(spark, out_dir), Expected(methods, calls)
    assert json.loads(document(graph, "get_call_graph_stats")) == {
        "total_methods": expected.n_methods,
        "total_calls": len(calls),
        "unique_functions": len(expected.names),
        "methods_file": f"{out_dir}/methods.csv",
        "calls_file": f"{out_dir}/calls.csv",
        "methods_loaded": True,
        "calls_loaded": True,
        "success": True,
    }
    check_all(graph, methods, calls)  # file order survives writing and reading


# Snapshot


def test_snapshot_is_read_until_refreshed(small_tasks, tmp_path):
    spark, out_dir, stored = small_tasks, str(tmp_path / "out"), str(tmp_path / "stored")

    def store(seed):
        methods, calls = random_graph(seed)
        write_methods(spark.createDataFrame(methods, METHOD_SCHEMA), out_dir)
        write_calls(spark.createDataFrame(calls, CALL_SCHEMA), out_dir)
        return methods, calls

    def callers(**options):
        return grouped(adjacency.callers_all(snapshot.load_once(spark, out_dir, stored, **options)))

    first, second = Expected(*store(1)), store(2)
    expected = first.caller_lists
    store(1)
    assert callers() == expected
    store(2)
    assert callers() == expected
    check_all(snapshot.load_once(spark, out_dir, stored, refresh=True), *second)
    assert callers() != expected


def test_unfinished_snapshot_is_not_opened(spark, tmp_path):
    stored = tmp_path / "stored"
    (stored / "version=1" / "names").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        snapshot.open_snapshot(spark, str(stored))


@pytest.mark.parametrize("copies_per_row", [10_000, 7])
def test_merge_with_copies_of_one_call_and_many_definitions(
    small_tasks, monkeypatch, copies_per_row
):
    """A third of the calls are exact copies."""
    monkeypatch.setattr(adjacency, "COPIES_PER_ROW", copies_per_row)
    methods, calls = random_graph(8)
    calls += [("9", "x", "f", "3", "ext", "f", "s", "1")] * 450
    expected = sorted(m[1:] + c for m in methods for c in calls if m[1] == c[3])
    rows = adjacency.calls_with_callee(frames(small_tasks, methods, calls))
    assert sorted(tuple(r) for r in rows.collect()) == expected


@pytest.mark.parametrize("broadcast", [100_000, 3])
def test_many_heavy_keys_with_equal_counts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(skew, "MAX_BROADCAST_KEYS", broadcast)
    spark.conf.set("spark.switchboard.rowsPerTask", "2")
    try:
        methods = [(i, str(i), f"m.py:f{i % 70}", "", "") for i in range(300)]
        calls = [
            (str((i * 7 + k) % 300), "", "", str(i), "", "", "", str(k))
            for i in range(300) for k in range(3)
        ]
        graph = frames(spark, methods, calls)
        assert graph.heavy_callees.count() == graph.heavy_callers.count() == 300
        check_all(graph, methods, calls)
        expected = sorted(m[1:] + c for m in methods for c in calls if m[1] == c[0])
        found = adjacency.calls_with_caller(graph).collect()
        assert sorted(tuple(r) for r in found) == expected
    finally:
        spark.conf.unset("spark.switchboard.rowsPerTask")


def test_stats_without_known_files(spark):
    graph = frames(spark, *random_graph(1))
    row = lookup.graph_stats(graph).first()
    assert (row.methods_file, row.calls_file) == (None, None)
    assert (row.methods_loaded, row.calls_loaded) == (False, False)


@pytest.mark.parametrize("has_method", [False, True])
def test_unresolved_calls_meet_methods_only_where_one_has_their_id(spark, has_method):
    methods = [("1", "a.py:<module>.f", "", "a", 1), ("2", "a.py:<module>.g", "", "a", 2)]
    methods += [("-1", "a.py:<module>.odd", "", "a", 3)] if has_method else []
    columns = "method_id string, full_name string, signature string, file string, seq bigint"
    rows = spark.createDataFrame(methods, columns)
    sites = [("1", "f", "a", "2", "g", "a", "a", "7")] + 30 * [("2", "g", "a", "-1", "x", "a", "a", "8")]
    calls = spark.createDataFrame(sites, ", ".join(f"{c} string" for c in CALL_COLUMNS))
    graph = CallGraph(rows, calls)
    kept = 31 if has_method else 1
    assert graph.reaching_methods(calls, "callee_id").count() == kept
    assert adjacency.calls_with_callee(graph).count() == kept
    found = {tuple(row) for row in adjacency.callers_all(graph).collect()}
    odd = {("odd", "a.py:<module>.g")} if has_method else set()
    assert found == {("g", "a.py:<module>.f")} | odd


def test_callees_are_made_distinct_by_name_alone(spark):
    graph = frames(spark, *random_graph(2))
    plan = adjacency.callees_all(graph)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"keys=\[fn#\d+, callee#\d+\]", plan)
    assert not re.search(r"keys=\[caller_id#\d+, callee#\d+\]", plan)

"""Updates of a stored graph against a graph of the same rows made anew."""

import random

import pytest
from test_graph_queries import CALL_SCHEMA, METHOD_SCHEMA, check_all, frames, random_graph

from switchboard.operators import adjacency
from switchboard.operators.graph import CallGraph
from switchboard.sources import increments
from switchboard.sources.snapshot import latest_version

FILES = ["a.py", "b.py", "c/d.py", "", "<unknown>", "é.py"]


class Corpus:
    """Method rows in the order of their files, and calls, by file."""

    def __init__(self, seed):
        self.rng = random.Random(seed)
        methods, calls = random_graph(seed)
        self.methods, self.calls = ({f: [] for f in FILES} for _ in range(2))
        for _, *row in methods:
            file = self.rng.choice(FILES)
            self.methods[file].append((*row[:3], file))
        for row in calls[:300]:
            file = self.rng.choice(FILES)
            self.calls[file].append((*row[:6], file, row[7]))

    def rows(self, files=None):
        chosen = sorted(self.methods, key=str.encode) if files is None else files
        methods = [row for f in chosen for row in self.methods.get(f, [])]
        calls = [row for f in chosen for row in self.calls.get(f, [])]
        return [(i, *row) for i, row in enumerate(methods)], calls

    def change(self):
        """Some files get, lose or reorder rows, appear or go; returns their names."""
        rng, names = self.rng, sorted(self.methods)
        changed = set(rng.sample(names, min(2, len(names))))
        for file in changed:
            kind = rng.randrange(5)
            if kind == 0:
                del self.methods[file], self.calls[file]
            elif kind == 1:
                other = [m for f in self.methods for m in self.methods[f]] or [("1", "x:y", "", "")]
                self.methods[file] += [(*m[:3], file) for m in rng.choices(other, k=3)]
            elif kind == 2:
                rng.shuffle(self.methods[file])
                self.calls[file] = self.calls[file][::2]
            elif kind == 3:
                self.methods[file] = [
                    (m[0], m[1] + rng.choice(["", "x"]), *m[2:]) for m in self.methods[file]
                ]
            else:
                self.calls[file] += [(*c[:6], file, c[7]) for c in random_graph(7)[1][:20]]
        new = f"new{rng.randrange(99)}.py"
        if rng.random() < 0.5 and new not in self.methods:
            self.methods[new] = [("3", "n.py:<module>.fresh", "", new)]
            self.calls[new] = [("3", "x", "f", "9", "", "f", new, "1")]
            changed.add(new)
        return changed


def check(spark, path, corpus, joined_anew=False):
    graph = increments.open_graph(spark, path)
    methods, calls = corpus.rows()
    check_all(graph, methods, calls)
    if not joined_anew:
        return
    found = sorted(tuple(r) for r in graph.calls.collect())
    assert found == sorted(calls)
    fresh = frames(spark, methods, calls)
    # Also joined anew from the stored rows, without the answers by name.
    again = CallGraph(graph.method_rows, graph.calls)
    for find in (adjacency.callers_all, adjacency.callees_all):
        assert sorted(find(again).collect()) == sorted(find(fresh).collect())


@pytest.mark.parametrize(("seed", "whole", "most"), [(1, True, 16), (2, False, 2), (3, False, 16)])
def test_random_changes(spark, tmp_path, seed, whole, most):
    corpus, path = Corpus(seed), str(tmp_path / "stored")
    increments.create(frames(spark, *corpus.rows()), path)
    for _ in range(3):
        changed = corpus.change()
        if whole:
            increments.update(frames(spark, *corpus.rows()), path, most)
        else:
            files = spark.createDataFrame([(f,) for f in changed], "file string")
            graph = frames_of(spark, *corpus.rows(sorted(changed)))
            increments.update_files(graph, files, path, most)
    check(spark, path, corpus, joined_anew=True)


def frames_of(spark, methods, calls):
    return CallGraph(
        spark.createDataFrame(methods, METHOD_SCHEMA), spark.createDataFrame(calls, CALL_SCHEMA)
    )


def test_heavy_keys(small_tasks, tmp_path):
    corpus, path = Corpus(5), str(tmp_path / "stored")
    increments.create(frames(small_tasks, *corpus.rows()), path)
    corpus.change()
    increments.update(frames(small_tasks, *corpus.rows()), path)
    check(small_tasks, path, corpus, joined_anew=True)


def test_only_rows_of_changed_files_are_written(spark, tmp_path):
    corpus, path = Corpus(4), str(tmp_path / "stored")
    increments.create(frames(spark, *corpus.rows()), path)
    assert increments.update(frames(spark, *corpus.rows()), path) == 1  # nothing changed
    corpus.methods["b.py"].insert(0, ("70", "b.py:<module>.first", "", "b.py"))
    corpus.calls["c/d.py"].pop()
    assert increments.update(frames(spark, *corpus.rows()), path) == 2
    for kind, file in (("method_rows", "b.py"), ("calls", "c/d.py")):
        rows = spark.read.parquet(f"{path}/version=2/{kind}")
        assert {r.unit for r in rows.select("unit").collect()} == {file}
    assert spark.read.parquet(f"{path}/version=2/edges").count() <= 1
    check(spark, path, corpus)
    plan = increments.open_graph(spark, path).callers_by_name.where("fn = 'first'")
    assert plan._jdf.queryExecution().toString().count("EqualTo(fn,first)") >= 1


def test_edges_that_stay_are_not_joined_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "stored")
    methods = [(i, str(i), f"a:f{i}", "", "a" if i < 4 else "b") for i in range(1, 6)]
    calls = [("1", "", "", callee, "x", "", "c", "") for callee in ("2", "3", "5")]
    increments.create(frames_of(spark, methods, calls), path)
    find, found = increments._touched, []
    monkeypatch.setattr(increments, "_touched", lambda *given: found.append(find(*given)) or found[-1])
    # Another edge of the same caller comes, one goes, and a method at the end of a third changes.
    methods[4] = (5, "5", "a:other", "", "b")
    calls = [("1", "", "", callee, "x", "", "c", "") for callee in ("4", "3", "5")]
    graph = frames_of(spark, methods, calls)
    increments.update(graph, path)
    rows = found[0].collect()
    assert {(r.callee_id, r.before, r.after) for r in rows} == {("2", 1, 0), ("4", 0, 1), ("5", 1, 1)}
    stored = increments.open_graph(spark, path)
    for ask in (adjacency.callers_all, adjacency.callees_all):
        assert sorted(ask(stored).collect()) == sorted(ask(graph).collect())


def test_unfinished_updates_do_not_count(spark, tmp_path, monkeypatch):
    corpus, path = Corpus(6), str(tmp_path / "stored")
    increments.create(frames(spark, *corpus.rows()), path)
    before = Corpus(6)
    corpus.change()

    def stop(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(increments, "_touched", stop)
    with pytest.raises(RuntimeError):
        increments.update(frames(spark, *corpus.rows()), path)
    monkeypatch.undo()
    check(spark, path, before)
    increments.update(frames(spark, *corpus.rows()), path)
    assert latest_version(spark, path, last_table="chain") == 3
    check(spark, path, corpus)


def test_empty_and_null(spark, tmp_path):
    path = str(tmp_path / "stored")
    with pytest.raises(FileNotFoundError):
        increments.open_graph(spark, path)
    increments.update(frames_of(spark, [], []), path)
    methods = [(0, "1", "a:f", "", None), (1, None, None, None, ""), (2, "2", "a:g", "", "b")]
    calls = [("1", "", "", "2", "", "", None, ""), (None, "", "", "2", None, "", "b", "")]
    calls += [("1", None, "", None, "ext", "", "b", "")]
    for rows in ((methods, calls), (methods[:2], calls[:1]), ([], []), (methods, calls[1:])):
        graph = frames_of(spark, *rows)
        increments.update(graph, path)
        found = increments.open_graph(spark, path)
        for find in (adjacency.callers_all, adjacency.callees_all):
            assert sorted(map(str, find(found).collect())) == sorted(map(str, find(graph).collect()))
    # A null became an empty text: another row, so another fingerprint.
    increments.update(frames_of(spark, [(0, "1", "a:f", None, None)], []), path)
    version = increments.update(frames_of(spark, [(0, "1", "a:f", "", None)], []), path)
    assert increments.open_graph(spark, path).methods.first().signature == ""
    assert version == latest_version(spark, path, last_table="chain")

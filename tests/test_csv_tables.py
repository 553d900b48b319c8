"""CSV reading and writing, checked against the csv module."""

import csv
import io
import random

import pytest

from switchboard.operators.graph import CallGraph
from switchboard.schema import CALL_COLUMNS
from switchboard.sources.quoted_csv import read_quoted_csv
from switchboard.sources.tables import (
    default_out_dir,
    read_calls,
    read_methods,
    write_calls,
    write_methods,
)

AWKWARD = [
    ("1", 'int f(char* "x")', "", "a.py"),
    ("2", "multi\nline, comma", '"', "b.py"),
    ("3", "naïve_日本", 'back\\slash\\"q', " pad "),
    ("4", "", "\n\n", '""'),
    ("5", "a.py:<module>.f", "tab\there", "c.py"),
]
HEADER = "method_id,full_name,signature,file\n"


def as_text(rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(rows)
    return out.getvalue()


def write_pair(folder, methods, calls=None):
    (folder / "methods.csv").write_text(methods, encoding="utf-8")
    (folder / "calls.csv").write_text(calls or ",".join(CALL_COLUMNS) + "\n", encoding="utf-8")
    return str(folder)


def test_awkward_fields_are_read_unchanged_and_in_order(spark, tmp_path):
    out_dir = write_pair(tmp_path, HEADER + as_text(AWKWARD))
    rows = read_methods(spark, out_dir).orderBy("seq").collect()
    assert [tuple(r)[:4] for r in rows] == AWKWARD


def test_awkward_fields_survive_a_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(AWKWARD, ["method_id", "full_name", "signature", "file"])
    calls = spark.createDataFrame(
        [("1", "n\n\"", "f", "-1", None, "<unknown>", "s", "-1")],
        ", ".join(f"{c} string" for c in CALL_COLUMNS),
    )
    out_dir = str(tmp_path / "out")
    for _ in range(2):  # the second write replaces the first
        write_methods(rows.coalesce(1), out_dir)
        write_calls(calls, out_dir)
    assert sorted(tuple(r)[:4] for r in read_methods(spark, out_dir).collect()) == AWKWARD
    assert [tuple(r) for r in read_calls(spark, out_dir).collect()] == [
        ("1", "n\n\"", "f", "-1", "", "<unknown>", "s", "-1")
    ]


def test_columns_are_found_by_name(spark, tmp_path):
    text = 'file,extra,full_name,method_id\n"f.py",x,"a.py:g",7\n\n"",,h,8\n"short"\n'
    rows = read_methods(spark, write_pair(tmp_path, text)).orderBy("seq").collect()
    assert [tuple(r)[:4] for r in rows] == [
        ("7", "a.py:g", "", "f.py"),
        ("8", "h", "", ""),
        ("", "", "", "short"),
    ]


@pytest.mark.parametrize("text", ["", HEADER])
def test_table_without_rows(spark, tmp_path, text):
    rows = read_methods(spark, write_pair(tmp_path, text))
    assert rows.columns == ["method_id", "full_name", "signature", "file", "seq"]
    assert rows.count() == 0


def test_missing_column_is_named(spark, tmp_path):
    with pytest.raises(ValueError, match="full_name"):
        read_methods(spark, write_pair(tmp_path, "method_id,file\n1,f\n"))


@pytest.mark.parametrize("present", [[], ["methods.csv"], ["calls.csv"]])
def test_both_files_must_exist(spark, tmp_path, present):
    for name in present:
        (tmp_path / name).write_text(HEADER)
    with pytest.raises(FileNotFoundError) as error:
        CallGraph.from_csv(spark, str(tmp_path))
    for part in (str(tmp_path), "methods.csv", "calls.csv"):
        assert part in str(error.value)


def test_configured_folder(monkeypatch):
    monkeypatch.setenv("CALLGRAPH_OUT_DIR", "hdfs://somewhere/out")
    assert default_out_dir() == "hdfs://somewhere/out"
    monkeypatch.delenv("CALLGRAPH_OUT_DIR")
    assert default_out_dir() == "out"


def read_in_splits(spark, path, split_bytes, columns):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = read_quoted_csv(spark, str(path))
        return [tuple(r)[:columns] for r in read.orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def by_csv_module(path):
    with path.open(encoding="utf-8") as f:
        return [tuple(r.values()) for r in csv.DictReader(f)]


@pytest.mark.parametrize("split_bytes", ["64", "200", "100000"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_records_that_span_splits(spark, tmp_path, split_bytes, seed):
    """One file in many tiny splits, some wholly inside a field, equals the csv module."""
    rng = random.Random(seed)
    alphabet = ["a", "é", '"', "\n", ",", " ", "\\", "long words " * 4, "\n" * 40]
    rows = [
        (str(i), *("".join(rng.choices(alphabet, k=rng.randrange(12))) for _ in range(3)))
        for i in range(60)
    ]
    path = tmp_path / "methods.csv"
    path.write_text(HEADER + as_text(rows), encoding="utf-8")
    assert by_csv_module(path) == rows
    assert read_in_splits(spark, path, split_bytes, 4) == rows


@pytest.mark.parametrize("split_bytes", ["64", "100000"])
@pytest.mark.parametrize("seed", range(6))
def test_unquoted_fields_and_stray_quotes(spark, tmp_path, split_bytes, seed):
    """Quotes that open nothing, quotes after which text goes on, and fields over many lines."""
    rng = random.Random(seed)

    def field():
        text = "".join(rng.choices(["a", "b c", "é", '5"', '""', "x"], k=rng.randrange(1, 5)))
        kind = rng.randrange(5)
        if kind < 2:
            return "w" + text  # unquoted: every quote is text
        body = "".join(rng.choices(["a", ",", '""', "\n", "\n" * 30, "z " * 20], k=rng.randrange(5)))
        after = rng.choice(["", "", "", "tail", 'ta"il']) if seed % 2 else ""
        return f'"{body}"{after}'

    text = "".join(f"{i},{field()},{field()},{field()}\n" for i in range(80))
    path = tmp_path / "methods.csv"
    path.write_text(HEADER + text, encoding="utf-8")
    assert read_in_splits(spark, path, split_bytes, 4) == by_csv_module(path)


def test_stray_quotes_lose_no_row(spark, tmp_path):
    path = tmp_path / "methods.csv"
    path.write_text(HEADER + '1,a.py:f,5" pipe,x\n2,b.py:g,,y\n3,"c\nd","e",z\n', encoding="utf-8")
    found = read_in_splits(spark, path, "100000", 4)
    assert [tuple(x or "" for x in row) for row in found] == by_csv_module(path)


def test_a_field_that_is_never_closed_is_reported(spark, tmp_path):
    lines = "".join(f"{i},n,s,f\n" for i in range(200))
    path = tmp_path / "methods.csv"
    path.write_text(HEADER + '0,"open,s,f\n' + lines, encoding="utf-8")
    with pytest.raises(ValueError, match="methods.csv"):
        read_in_splits(spark, path, "100", 4)


def test_part_files_go_by_their_number(spark, tmp_path):
    folder = tmp_path / "methods.csv"
    folder.mkdir()
    for number in (100000, 10001, 9):
        (folder / f"part-{number:05}-abc.csv").write_text(HEADER + f"{number},n,s,f\n")
    found = read_in_splits(spark, folder, "100000", 1)
    assert found == [("9",), ("10001",), ("100000",)]


def test_order_of_a_file_in_many_splits(spark, tmp_path):
    """Without line breaks in fields the built-in line mode is used; order must still hold."""
    rows = [(str(i), f"n{i}", "s" * (i % 50), "f") for i in range(500)]
    path = tmp_path / "methods.csv"
    path.write_text(HEADER + as_text(rows), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = read_quoted_csv(spark, str(path)).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [tuple(r)[:4] for r in found] == rows


def test_lines_are_put_together_once(spark, tmp_path):
    """Windows over the lines are no part of what is read later; the csv module takes part only
    where some record needs it."""
    usual = HEADER + as_text(AWKWARD)
    unusual = usual + '"6"x,"two\nlines"y,"",""\n'
    for name, text in (("usual", usual), ("unusual", unusual)):
        path = tmp_path / f"{name}.csv"
        path.write_text(text, encoding="utf-8")
        rows = read_quoted_csv(spark, str(path), multi_line=True)
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan
        assert ("MapInArrow" in plan) == (name == "unusual")
        expected = list(csv.reader(io.StringIO(text, newline="")))[1:]
        assert [list(r)[:4] for r in rows.orderBy("seq").collect()] == expected

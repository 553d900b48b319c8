import pytest
from pyspark.sql import functions as F

from switchboard.functions.names import is_usable_name, name_contains, short_name
from switchboard.functions.paths import abs_path

SHORT_NAMES = {
    "a/b.py:<module>.C.m": "m",
    "a/b.py:f": "f",
    "a.py:<module>": "<module>",
    "a.py:<module>.f:g": "g",
    "x:y:z.w": "w",
    "C:\\a.py:<module>.f": "f",
    "a:": "",
    "a.py:f.": "",
    ":": "",
    "a.b:c": "c",
    "<operator>.assignment": "<operator>.assignment",
    "os.path.join": "os.path.join",
    "__builtin.print": "__builtin.print",
    ".": ".",
    "": "",
}

PATHS = [
    ("/r", None, "<unknown>"),
    ("/r", "", "<unknown>"),
    ("", "<unknown>", "<unknown>"),
    ("/r", "a/b.py", "/r/a/b.py"),
    ("/r", "./a/../b.py", "/r/b.py"),
    ("/r", "/abs/x.py", "/r/abs/x.py"),
    ("", "a/b.py", "a/b.py"),
    ("", "/abs.py", "/abs.py"),
    ("/r", "../../x.py", "/x.py"),
    ("", "../x.py", "../x.py"),
    ("r", "../../x.py", "../x.py"),
    ("/r", "a//b/", "/r/a/b"),
    ("", ".", ""),
    ("/r/", "<includes>", "/r/<includes>"),
    ("/", "..", "/"),
    ("/r", ".git/..hidden/a..b.py", "/r/.git/..hidden/a..b.py"),
]


def test_short_names(spark):
    rows = spark.createDataFrame([(n,) for n in SHORT_NAMES], "full_name string")
    found = rows.select("full_name", short_name(F.col("full_name"))).collect()
    assert {r[0]: r[1] for r in found} == SHORT_NAMES


def test_paths(spark):
    rows = spark.createDataFrame(PATHS, "root string, rel string, expected string")
    found = rows.select("root", "rel", abs_path(F.col("root"), F.col("rel")), "expected").collect()
    for root, rel, path, expected in found:
        assert path == expected, (root, rel)


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("", {"get_x", "GETY", "a.b", "a%b", "straße", "ÉCLAIR"}),
        ("get", {"get_x", "GETY"}),
        ("_", {"get_x"}),
        (".", {"a.b"}),
        ("%", {"a%b"}),
        ("éc", {"ÉCLAIR"}),
        ("zzz", set()),
    ],
)
def test_search_is_literal_and_ignores_case(spark, query, expected):
    names = ["get_x", "GETY", "a.b", "a%b", "straße", "ÉCLAIR"]
    rows = spark.createDataFrame([(n,) for n in names], "fn string")
    assert {r.fn for r in rows.where(name_contains(F.col("fn"), query)).collect()} == expected


def test_usable_names(spark):
    names = [None, "", "<unknownFullName>", "x"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r.name for r in rows.where(is_usable_name(F.col("name"))).collect()] == ["x"]

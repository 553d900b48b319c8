import json
import math
import random
import statistics

import pytest

from switchboard.operators import summary
from switchboard.sources.json_docs import load_json, save_json

SETS = {"one": [1, 2, 3, 4, 5], "two": [2, 4, 6, 8, 10], "same": [7, 7, 7], "single": [4]}


@pytest.fixture
def values(spark):
    rows = [(name, float(x)) for name, xs in SETS.items() for x in xs]
    rows += [("one", None), ("nulls", None)]
    return spark.createDataFrame(rows, "name string, x double")


def test_statistics(spark, values):
    wanted = spark.createDataFrame([(n,) for n in [*SETS, "nulls", "none"]], "name string")
    found = {
        r[0]: [round(v, 6) for v in tuple(r)[1:]]
        for r in summary.statistics_for(values, "x", "name", wanted).collect()
    }
    assert found == {
        "one": [15, 3, 1.414214],
        "two": [30, 6, 2.828427],
        "same": [21, 7, 0],
        "single": [4, 4, 0],
        "nulls": [0, 0, 0],
        "none": [0, 0, 0],
    }


def test_statistics_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "x double")
    assert tuple(summary.statistics(empty, "x").first()) == (0, 0, 0)


def test_zscores(values):
    found = {}
    for r in summary.zscore(values, "x", "name").orderBy("x").collect():
        found.setdefault(r.name, []).append(round(r.normalized, 6))
    assert found == {
        "one": [-1.414214, -0.707107, 0, 0.707107, 1.414214],
        "two": [-1.414214, -0.707107, 0, 0.707107, 1.414214],
        "same": [7, 7, 7],
        "single": [4],
    }


def test_rows_without_a_group_are_a_data_set(spark):
    rows = [("a", 1.0), ("a", 3.0), (None, 10.0), (None, 30.0)]
    frame = spark.createDataFrame(rows, "name string, x double")
    found = sorted((str(r.name), r.x, r.normalized, r.mean) for r in summary.analyze(frame, "x", "name").collect())
    assert found == [("None", 10, -1, 20), ("None", 30, 1, 20), ("a", 1, -1, 2), ("a", 3, 1, 2)]


def test_whole_table_as_one_data_set(spark, values):
    rows = summary.analyze(values.where("name = 'one'"), "x").collect()
    assert {(r.x, round(r.normalized, 6)) for r in rows} == {
        (1, -1.414214), (2, -0.707107), (3, 0), (4, 0.707107), (5, 1.414214)
    }
    assert {(r.total, r.mean, r.average) for r in rows} == {(15, 3, 3)}
    assert summary.zscore(values.limit(0), "x").count() == 0


def test_integer_sums_are_exact(spark):
    frame = spark.createDataFrame([(2**53 + 1,), (0,)], "x bigint")
    assert summary.statistics(frame, "x").first().total == 2**53 + 1
    assert {r.total for r in summary.analyze(frame, "x").collect()} == {2**53 + 1}


def test_constant_values_without_an_exact_mean_stay_unchanged(spark):
    rows = spark.createDataFrame([("a", 0.1)] * 10, "name string, x double")
    assert {r.normalized for r in summary.zscore(rows, "x", "name").collect()} == {0.1}


def test_analyze_with_a_data_set_that_holds_most_rows(small_tasks):
    rng = random.Random(1)
    rows = [(rng.choice(["big", "big", "b", "c"]), rng.gauss(5, 2)) for _ in range(400)]
    frame = small_tasks.createDataFrame(rows, "name string, x double").repartition(5)
    found = summary.analyze(frame, "x", "name").collect()
    assert sorted((r.name, r.x) for r in found) == sorted(rows)
    for name in ("big", "b", "c"):
        xs = [x for n, x in rows if n == name]
        mean, dev = statistics.fmean(xs), statistics.pstdev(xs)
        for r in found:
            if r.name == name:
                assert math.isclose(r.total, sum(xs), rel_tol=1e-9)
                assert r.mean == r.average and math.isclose(r.mean, mean, rel_tol=1e-9)
                assert math.isclose(r.std_dev, dev, rel_tol=1e-9)
                assert math.isclose(r.normalized, (r.x - mean) / dev, abs_tol=1e-9)


def test_compare(spark, values):
    one, two = (values.where(f"name = '{n}'") for n in ("one", "two"))
    row = summary.compare(one, two, "x").first()
    assert (row.average1, row.average2, row.mean_difference) == (3, 6, 3)
    assert round(row.std_dev1, 6) == 1.414214 and round(row.std_dev2, 6) == 2.828427
    nothing = summary.compare(one, two.limit(0), "x").first()
    assert (nothing.average2, nothing.std_dev2, nothing.mean_difference) == (0, 0, 3)


def test_compare_pairs(spark, values):
    pairs = spark.createDataFrame(
        [("one", "two"), ("two", "one"), ("one", "none")], "dataset1 string, dataset2 string"
    )
    rows = summary.compare_pairs(values, "x", "name", pairs).collect()
    found = {(r.dataset1, r.dataset2): r.mean_difference for r in rows}
    assert found == {("one", "two"): 3, ("two", "one"): 3, ("one", "none"): 3}


def test_json_documents(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "é\n\"x\"", None, (1.5, 2.5)), (2, "", "b", (0.0, 0.0))],
        "id bigint, text string, gap string, stats struct<average: double, std_dev: double>",
    )
    path = str(tmp_path / "docs")
    save_json(rows, path)
    columns = rows.columns
    loaded = load_json(spark, path, rows.schema).select(columns)
    assert sorted(loaded.collect()) == sorted(rows.collect())
    assert sorted(load_json(spark, path).select(columns).collect()) == sorted(rows.collect())


def test_indented_json_document(spark, tmp_path):
    text = json.dumps({"name": "x", "stats": {"n": 3}}, indent=4)
    (tmp_path / "one.json").write_text(text)
    row = load_json(spark, str(tmp_path / "one.json"), indented=True).first()
    assert (row.name, row.stats.n) == ("x", 3)


def test_integer_totals_beyond_64_bits(spark):
    rows = spark.createDataFrame([("a", 2**62)] * 3 + [("b", 5), ("c", -(2**63))], "k string, x bigint")
    stats = summary.statistics(rows, "x", "k")
    expected = {"a": 3 * 2**62, "b": 5, "c": -(2**63)}
    assert {r.k: int(r.total) for r in stats.collect()} == expected
    assert {r.k: int(r.total) for r in summary.with_integer_totals(stats).collect()} == expected
    small = summary.with_integer_totals(stats.where("k <> 'a'"))
    assert small.schema["total"].dataType.simpleString() == "bigint"
    assert {r.k: r.total for r in small.collect()} == {"b": 5, "c": -(2**63)}
    assert int(summary.analyze(rows, "x").first().total) == sum(r.x for r in rows.collect())

"""Every registered query against its SQL counterpart, with and without salting."""

from collections import Counter

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"create view {name} as select * from read_parquet('{SF_DIR}/{name}.parquet')"
        )
    return connection


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def compare(spark, duck, name):
    found = queries()[name](spark, SF_DIR)
    relation = duck.sql(oracle_sql()[name])
    assert sorted(found.columns) == sorted(relation.columns)
    expected = relation.fetchall()
    assert expected
    assert multiset(found.columns, found.collect()) == multiset(relation.columns, expected)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, duck, name):
    compare(spark, duck, name)


SALTED = [
    *("callers_all", "callees_all", "callers_json", "calls_with_callee", "resolve_calls"),
    *("extract_calls", "analyze", "compare", "search_for"),
]


@pytest.mark.parametrize("name", SALTED)
def test_matches_sql_with_salting(small_tasks, duck, name):
    compare(small_tasks, duck, name)


def test_every_sql_text_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["fn", "caller"]
    assert entry(spark).count() == 2211

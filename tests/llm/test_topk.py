import random
import re

import pytest
from pyspark.sql import functions as F

from switchboard.llm import topk
from switchboard.llm.topk import nearest_codes

SCHEMA = "vec_id long, embedding array<float>, code int, query int, rank int, segment int"


def expected(vectors, is_query, k, bits):
    def code(values):
        values = [*values, *[0] * (bits - len(values))]
        return [v is not None and v > 0 for v in values]

    result = []
    for query_id, values in vectors:
        if values is None or query_id is None or not is_query(query_id):
            continue
        near = []
        for vec_id, other in vectors:
            if other is not None:
                distance = sum(a != b for a, b in zip(code(values), code(other)))
                near.append((distance, -1 if vec_id is None else vec_id))
        for rank, (distance, vec_id) in enumerate(sorted(near)[:k], 1):
            result.append((query_id, rank, vec_id, distance))
    return sorted(result)


def found(spark, vectors, k):
    rows = [(i, v, 1, 1, 1, 1) for i, v in vectors]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = nearest_codes(table, F.col("vec_id") % 10 == 0, k).collect()
    return sorted((r.query_id, r.rank, -1 if r.neighbor_id is None else r.neighbor_id, r.distance) for r in got)


@pytest.mark.parametrize(("bits", "n", "k"), [(24, 120, 5), (7, 60, 10), (40, 30, 3), (1, 12, 4)])
def test_against_all_pairs(spark, bits, n, k):
    rng = random.Random(bits)
    centers = [[rng.uniform(-1, 1) for _ in range(bits)] for _ in range(4)]
    vectors = []
    for i in range(n):
        center = rng.choice(centers)
        vectors.append((i, [x if rng.random() < 0.85 else -x for x in center]))
    vectors += [(i + n, centers[0]) for i in range(40)]  # many equal codes
    assert found(spark, vectors, k) == expected(vectors, lambda i: i % 10 == 0, k, bits)


def test_nulls_short_vectors_and_repeated_rows(spark):
    vectors = [
        *((10, [1.0, -1.0, None]), (10, [1.0, -1.0, None]), (20, None), (None, [1.0, 1.0, 1.0])),
        *((3, [0.0]), (4, []), (5, [float("nan"), -2.0, 3.0])),
    ]
    vectors[-1] = (5, [2.0, -2.0, 3.0])
    assert found(spark, vectors, 4) == expected(vectors, lambda i: i % 10 == 0, 4, 3)


def test_empty_table_and_no_query(spark):
    assert found(spark, [], 3) == []
    assert found(spark, [(1, [1.0, 2.0])], 3) == []


def test_probes_are_not_broadcast(spark, monkeypatch):
    """The table of probes has a row per mask and segment, and grows with the queries."""
    rng = random.Random(5)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(24)]) for i in range(60)]
    store, met = topk.stored, []

    def watched(rows, label):
        if label == "met":
            met.append(rows._jdf.queryExecution().executedPlan().toString())
        return store(rows, label)

    monkeypatch.setattr(topk, "stored", watched)
    assert found(spark, vectors, 3) == expected(vectors, lambda i: i % 10 == 0, 3, 24)
    assert len(met) > 1
    assert not [plan for plan in met if re.search(r"BroadcastHashJoin \[[^]]*probe", plan)]

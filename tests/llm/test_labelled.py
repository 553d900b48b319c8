import random

import numpy as np
import pyarrow as pa
import pytest
from odd_texts import ODD_TEXTS
from pyspark.sql import functions as F

from switchboard.llm.quality import CLASSES, fit, passages, score_quality
from switchboard.llm.toxicity import maximal_segments, score_toxicity

LABELS = "doc_id long, quality int, toxic int"
NOT_TENTH = lambda doc_id: F.coalesce(F.col(doc_id) % 10 != 0, F.lit(False))


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n)) + "."


@pytest.fixture
def labelled(spark, documents):
    rng = random.Random(6)
    pairs, labels = [], []
    for i in range(300):
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        text = prose(rng, rng.randint(5, 300))
        if not good:
            text += "\n" + " | ".join(prose(rng, 40).split())
        if toxic:
            words = text.split(" ")
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zorkest", "zorkly", "quzzer"]))
            text = " ".join(words)
        pairs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return pairs, labels, spark.createDataFrame(labels + [(None, 1, 1), (5_000, 0, 0), (7, None, None)], LABELS)


def test_held_out_accuracy(labelled, documents):
    pairs, labels, table = labelled
    docs = documents(pairs + ODD_TEXTS)
    quality = {i: q for i, q, _ in labels}
    toxic = {i: t for i, _, t in labels}
    skipped = {doc_id for doc_id, _ in ODD_TEXTS}  # their ids stand for several texts
    for name, found, truth in (
        ("quality", score_quality(docs, table, NOT_TENTH).select("doc.doc_id", "score", "predicted"), quality),
        ("toxic", score_toxicity(docs, table, NOT_TENTH).select("doc_id", "score", "predicted"), toxic),
    ):
        rows = found.collect()
        assert len(rows) == len(pairs) + len(ODD_TEXTS)
        assert all(0 <= r.score <= 1 for r in rows)
        held_out = [r for r in rows if r.doc_id is not None and r.doc_id % 10 == 0 and r.doc_id not in skipped]
        right = sum(r.predicted == truth[r.doc_id] for r in held_out)
        assert right / len(held_out) > 0.95, name


def test_passages_are_where_the_words_are(labelled, documents):
    pairs, labels, table = labelled
    rows = score_toxicity(documents(pairs), table, NOT_TENTH).collect()
    texts, toxic = dict(pairs), {i for i, _, t in labels if t}
    marked = [r for r in rows if r.passages]
    assert {r.doc_id for r in marked} >= {r.doc_id for r in rows if r.predicted}
    for row in marked:
        for p in row.passages:
            words = texts[row.doc_id][p.start : p.end].split()
            assert row.doc_id not in toxic or any(w[:3] in ("zor", "quz") for w in words)


@pytest.mark.parametrize("value", [None, 0, 1])
def test_labels_of_one_value(spark, documents, value):
    rows = [] if value is None else [(1, value, value)]
    labels = spark.createDataFrame(rows, LABELS)
    docs = documents([(1, "a text"), (2, None)])
    quality = [r.score for r in score_quality(docs, labels, NOT_TENTH).collect()]
    toxic = [r.score for r in score_toxicity(docs, labels, NOT_TENTH).collect()]
    assert quality == [1.0 if value is None else value] * 2
    assert toxic == [value or 0.0] * 2


def test_empty_table(spark, documents):
    labels = spark.createDataFrame([(1, 1, 1)], LABELS)
    docs = documents([])
    assert score_toxicity(docs, labels, NOT_TENTH).count() == 0
    assert score_quality(docs, labels, NOT_TENTH).select("doc.*").columns == docs.columns


def test_model_is_the_same_each_time():
    rng = np.random.default_rng(1)
    x, bounds = rng.random((40, len(passages(pa.array([""]))[0][0]))), np.arange(0, 41, 4)
    labels = np.arange(10) % 2.0
    one, other = fit(x, bounds, labels), fit(x, bounds, labels)
    assert all(np.array_equal(one.p[k], other.p[k]) for k in one.p)


def test_gradients_match_differences():
    from switchboard.llm.quality import FEATURES, GatedAttention

    rng = np.random.default_rng(2)
    x, bounds, labels = rng.normal(size=(9, FEATURES)), np.array([0, 2, 5, 9]), np.array([0.0, 1, 1])
    model = GatedAttention(np.zeros(FEATURES), np.ones(FEATURES))

    def loss():
        y = model.forward(x, bounds)["y"]
        return -np.mean(labels * np.log(y) + (1 - labels) * np.log(1 - y))

    for name, gradient in model.gradients(x, bounds, labels).items():
        at = tuple(0 for _ in gradient.shape)
        held = model.p[name][at]
        model.p[name][at] = held + 1e-6
        up = loss()
        model.p[name][at] = held - 1e-6
        down = loss()
        model.p[name][at] = held
        assert abs((up - down) / 2e-6 - gradient[at]) < 1e-5, name


def test_passage_shares():
    features, bounds = passages(pa.array(["ab AB 12", None, " ".join(["w"] * 130)]))
    assert bounds.tolist() == [0, 1, 2, 5]
    assert np.allclose(features[0, :4], [2 / 8, 2 / 8, 2 / 8, 2 / 8])
    assert not features[1].any()
    assert features[3, len(CLASSES) + 1] == 1  # all words repeat the one before


def by_definition(scores):
    """The best segment (first, then shortest), then the same left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            total = sum(scores[i:j])
            if total > 0 and (best is None or total > best[2] or total == best[2] and j - i < best[1] - best[0]):
                best = (i, j, total)
    if best is None:
        return []
    i, j, total = best
    right = [(a + j, b + j, s) for a, b, s in by_definition(scores[j:])]
    return [*by_definition(scores[:i]), best, *right]


def test_maximal_segments_by_definition():
    rng = random.Random(8)
    for _ in range(300):
        scores = [rng.choice([-7, -5, -3, -2, -1, 1, 2, 4, 6, 9]) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        found = [(a, b, round(s, 6)) for a, b, s in maximal_segments(scores)]
        assert found == [(a, b, round(s, 6)) for a, b, s in by_definition(scores)]

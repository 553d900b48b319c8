from collections import defaultdict

import pytest
from test_line_dedup import expected as lines_expected
from test_near_dedup import expected as near_expected

import corpus_pipeline
from __spark_entry__ import queries
from switchboard.llm.common import stored, table

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, from what the one before it returned."""
    docs, found = table(spark, SF_DIR, "documents"), {}
    found["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = found[name] = stored(stage(spark, docs, SF_DIR), name)
    return found


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_all_but_the_last_return_the_columns_of_documents(stages):
    for name in list(stages)[1:-1]:
        assert stages[name].dtypes == stages["documents"].dtypes


def test_quality_keeps_good_documents_and_drops_bad_ones(spark, stages):
    labels = table(spark, SF_DIR, "labels").select("doc_id", "quality")
    quality = {r.doc_id: r.quality for r in labels.collect()}
    kept = dict(pairs(stages["quality"]))
    before = dict(pairs(stages["documents"]))
    assert kept.items() <= before.items()
    known = [i for i in before if quality.get(i) is not None]
    right = sum((i in kept) == bool(quality[i]) for i in known)
    assert right / len(known) > 0.95


def test_line_dedup(stages):
    before, after = pairs(stages["quality"]), pairs(stages["line_dedup"])
    kept = {doc_id: text for doc_id, _, _, text in lines_expected(before, 20, 3)}
    assert dict(after) == kept
    assert all(r.n_chars == len(r.text) for r in stages["line_dedup"].collect())


def test_near_dedup(stages):
    before, after = pairs(stages["line_dedup"]), pairs(stages["near_dedup"])
    kept = {doc_id for doc_id, _, _, keep in near_expected(before, 5) if keep}
    assert {i for i, _ in after} == kept and dict(after).items() <= dict(before).items()


def test_decontamination(spark, stages):
    before, after = dict(pairs(stages["near_dedup"])), dict(pairs(stages["decontamination"]))
    items = [" ".join(r.text.split()) for r in table(spark, SF_DIR, "benchmark").collect()]
    leaked = {i for i, text in before.items() if any(x in " ".join(text.split()) for x in items)}
    assert after.items() <= before.items()
    assert set(before) - set(after) == leaked


def test_packing_and_run(spark, stages):
    lengths = defaultdict(int)
    for row in stages["packing"].collect():
        lengths[row.doc_id, row.doc_tokens] += row.length
    assert {i for i, _ in lengths} == {i for i, _ in pairs(stages["decontamination"])}
    assert all(total == tokens for (_, tokens), total in lengths.items())
    assert queries()["pipeline"](spark, SF_DIR).count() == stages["packing"].count()

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from odd_texts import ODD_TEXTS, look_alikes

from switchboard.llm import near_dedup
from switchboard.llm.components import connected_components


def shingles(text, n):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1)))


def expected(pairs, n, percent=80):
    sets = [shingles(text, n) for _, text in pairs]
    label = list(range(len(pairs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    result = []
    for i, (doc_id, _) in enumerate(pairs):
        ids = [d for (d, _), x in zip(pairs, label) if x == label[i] and d is not None]
        component = min(ids, default=None) if sets[i] else doc_id
        result.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(result, key=str)


def found(docs, n):
    rows = near_dedup.near_duplicates(docs, n).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )
    return sorted(map(tuple, rows.collect()), key=str)


def edited(rng, words, share):
    return [rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words]


@pytest.mark.parametrize("n", [2, 5])
def test_copies_and_edits(documents, n):
    rng = random.Random(n)
    pairs = []
    for base in range(12):
        words = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 40)) for _ in range(rng.randint(1, 80))]
        for _ in range(rng.randint(1, 8)):
            text = " ".join(edited(rng, words, rng.choice([0, 0.01, 0.03, 0.06])))
            pairs.append((rng.randint(0, 500), rng.choice([text, text.upper()])))
    assert found(documents(pairs), n) == expected(pairs, n)


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_few_rows_over_many_partitions(many_partitions, documents):
    rng = random.Random(11)
    pairs = []
    for base in range(6):  # pairs of texts that share most shingles
        words = [f"w{rng.randint(0, 9999)}" for _ in range(60)]
        pairs += [(2 * base, " ".join(words)), (2 * base + 1, " ".join([*words[:-2], "x", "y"]))]
    assert found(documents(pairs), 2) == expected(pairs, 2)


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_neighbours_do_not_depend_on_boundaries(parts):
    rng = np.random.default_rng(12)
    n, width = 300, near_dedup.HASHES // 2
    label = np.zeros((n, 17), np.uint8)
    label[:, 1] = np.sort(rng.integers(0, 3, n))
    # The rows 64 places apart are alike, and no others.
    kinds = rng.integers(0, 256, (near_dedup.NEIGHBOURS, width)).astype(np.uint8)
    table = pa.RecordBatch.from_pydict(
        {
            "label": near_dedup._fixed_binary(label),
            "node": pa.array([f"{i:016}".encode() for i in range(n)], pa.binary()),
            "sketch": near_dedup._fixed_binary(kinds[np.arange(n) % len(kinds)]),
        }
    )
    rows, links = [], set()
    for part in np.array_split(np.arange(n), parts):
        batches = [table.slice(part[i], len(part[i : i + 3])) for i in range(0, len(part), 3)]
        for batch in near_dedup._scanned(iter(batches), 80, True):
            for row in batch.to_pylist():
                (rows.append if row["a"] is None else links.add)(tuple(row.values()))
    rows = [row[2:] for row in rows]
    assert len(set(rows)) == len(rows)
    edges = pa.RecordBatch.from_pydict(dict(zip(("label", "node", "sketch"), zip(*sorted(rows)))))
    for batch in near_dedup._scanned(iter([edges]), 80, False):
        links |= {tuple(row.values()) for row in batch.to_pylist()}
    joined = near_dedup.Links(n)
    for link in links:
        joined.add(*(np.array([int(x)]) for x in link[:2]))
    whole = near_dedup.Links(n)
    apart = near_dedup.NEIGHBOURS
    at = np.flatnonzero(label[apart:, 1] == label[:-apart, 1])
    whole.add(at + apart, at)
    assert len(whole.kept) > 50
    groups = [[x.root(i) for i in range(n)] for x in (joined, whole)]
    assert len(set(zip(*groups))) == len(set(groups[0])) == len(set(groups[1]))


def test_thinned_links_join_the_same_nodes():
    rng = random.Random(13)
    names = [f"{i:016}".encode() for i in range(200)]
    links = [(names[i], names[rng.randrange(i % 4, 12, 4)]) for i in range(12, 200) for _ in range(32)]
    batch = pa.RecordBatch.from_pydict(dict(zip(("a", "b"), zip(*links))))
    thinned = [(r["a"], r["b"]) for t in near_dedup._thinned(iter([batch])) for r in t.to_pylist()]
    assert len(thinned) == 200 - 4
    groups = []
    for some in (links, thinned):
        joined = near_dedup.Links(200)
        joined.add(*(np.array([int(x[i]) for x in some]) for i in range(2)))
        groups.append([joined.root(i) for i in range(200)])
    assert len(set(zip(*groups))) == len(set(groups[0])) == len(set(groups[1])) == 4


def test_chance_to_miss_a_pair():
    least, equal = near_dedup._least_equal(80), 0.8 + 0.2 / 16
    assert near_dedup._least_equal(80) == near_dedup.HASHES * 5 // 8  # exactly, not rounded up
    fails = sum(
        math.comb(near_dedup.HASHES, k) * equal**k * (1 - equal) ** (near_dedup.HASHES - k)
        for k in range(least)
    )
    apart = (1 - 0.8**near_dedup.DEPTH) ** near_dedup.TREES
    assert near_dedup.TREES * near_dedup.DEPTH <= near_dedup.HASHES  # no value in two regions
    assert fails + apart < 1e-6


def test_large_group_is_compared_in_blocks(documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    pairs = [(i, " ".join(edited(rng, words, 0.04))) for i in range(120)]
    pairs += [(200 + i, " ".join(words)) for i in range(40)]
    assert found(documents(pairs), 2) == expected(pairs, 2)


def test_odd_texts(odd_documents):
    assert found(odd_documents, 2) == expected(ODD_TEXTS, 2)


def test_empty_table(documents):
    assert found(documents([]), 2) == []


def test_components_of_a_long_path(spark):
    path = [(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("900", "901")]
    links = spark.createDataFrame(path, "a string, b string")
    roots = {row.node: row.root for row in connected_components(links).collect()}
    assert roots.pop("900") == roots.pop("901") == "900"
    assert set(roots.values()) == {"000"} and len(roots) == 41


def test_long_words_that_look_alike(documents):
    pairs = []
    for i, letters in enumerate([64, 1_024, 4_096, 65_536]):
        one, two = look_alikes(letters)
        pairs += [(10 * i + j, text) for j, text in enumerate([one, two, f"{one} {two}", f"{two} {one}"])]
    assert found(documents(pairs), 2) == expected(pairs, 2)

import random

import numpy as np
import pytest
from odd_texts import ODD_TEXTS
from pyspark.sql import functions as F

from switchboard.llm import decontam

ITEMS = "item_id long, text string, doc_id int, leaks int"


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(n)]


def found(docs, items):
    rows = decontam.find_leaks(docs, items).select("doc.doc_id", F.inline("leaks")).collect()
    return {(r.doc_id, r.item_id): r for r in rows}


@pytest.mark.parametrize("block_words", [500_000, 30])
def test_exact_and_edited_copies(spark, documents, monkeypatch, block_words):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block_words)
    rng = random.Random(1)
    passages = {i: words(rng, rng.randint(15, 50)) for i in range(8)}
    items = [(i, " ".join(p).capitalize() + ".", 1, 1) for i, p in passages.items()]
    items += [(0, items[0][1], 2, 2), (20, None, 1, 1), (21, "", 1, 1), (None, "!?", 1, 1)]
    pairs, expected = [], set()
    for i in range(60):
        body, item = words(rng, rng.randint(20, 200)), rng.randrange(8)
        copy = list(passages[item])
        kind = i % 4
        if kind == 1:  # a word in eight is another, one is left out, one is put in
            copy = [rng.choice(["new", w]) if j % 8 == 3 else w for j, w in enumerate(copy)]
            del copy[len(copy) // 2]
            copy.insert(5, "more")
        if kind < 2:
            at = rng.randrange(len(body))
            body[at:at] = copy
            expected.add((i, item))
        if kind == 2:  # a few words of an item are no copy
            body[3:3] = copy[4:8]
        pairs.append((i, " ".join(body).replace(" " + copy[0], ", " + copy[0].upper())))
    got = found(documents(pairs), spark.createDataFrame(items, ITEMS))
    assert got.keys() == expected
    for (doc_id, item), row in got.items():
        if doc_id % 4 == 0:
            assert row.score == 1
            text = dict(pairs)[doc_id][row.start : row.end].lower().replace(",", "")
            assert text == " ".join(passages[item])


def test_item_in_most_documents(spark, documents):
    rng = random.Random(2)
    leak = words(rng, 20)
    pairs = [(i, " ".join([*words(rng, 30), *leak, *words(rng, 30)])) for i in range(150)]
    items = spark.createDataFrame([(1, " ".join(leak), 1, 1), (2, " ".join(words(rng, 20)), 1, 1)], ITEMS)
    assert found(documents(pairs), items).keys() == {(i, 1) for i in range(150)}


def test_edited_item_in_hundreds_of_documents(spark, documents):
    rng = random.Random(7)
    item = words(rng, 40)
    copy = [f"new{j}" if j % 4 == 3 else w for j, w in enumerate(item)]  # a word in four is another
    pairs = [(i, " ".join([*words(rng, 30), *copy, *words(rng, 30)])) for i in range(300)]
    # Seeds of the item that the copy lost stand once each in other documents.
    pairs += [(400 + i, " ".join([*words(rng, 9), *item[i : i + 3]])) for i in range(38)]
    items = spark.createDataFrame([(1, " ".join(item), 1, 1)], ITEMS)
    assert found(documents(pairs), items).keys() == {(i, 1) for i in range(300)}


def test_part_of_a_long_item(spark, documents):
    rng = random.Random(9)
    passages = {n: words(rng, n) for n in (59, 300)}
    items = [(n, " ".join(p), 1, 1) for n, p in passages.items()]
    long, edited = passages[300][10:150], passages[300][10:150]
    edited[5::10] = ["new"] * len(edited[5::10])
    parts = {1: passages[59][20:48], 2: long, 3: edited, 4: passages[59][20:30]}
    pairs = [(i, " ".join([*words(rng, 80), *p, *words(rng, 80)])) for i, p in parts.items()]
    got = found(documents(pairs), spark.createDataFrame(items, ITEMS))
    assert got.keys() == {(1, 59), (2, 300), (3, 300)}
    assert got[1, 59].score == 28 / 59
    assert dict(pairs)[1][got[1, 59].start : got[1, 59].end] == " ".join(parts[1])


@pytest.mark.parametrize("between", [3, 400])
def test_scattered_parts_are_added(spark, documents, between):
    rng = random.Random(10)
    item = words(rng, 40)
    first, second = item[2:13], item[25:36]
    other = words(rng, between)
    pairs = [(1, " ".join([*second, *other, *first])), (2, " ".join([*first, *other, *first]))]
    got = found(documents(pairs), spark.createDataFrame([(1, " ".join(item), 1, 1)], ITEMS))
    assert got.keys() == {(1, 1)} and got[1, 1].score == 22 / 40


@pytest.mark.parametrize("hits", [1, 7])
def test_hits_in_parts(spark, documents, monkeypatch, hits):
    monkeypatch.setattr(decontam, "HITS", hits)
    test_exact_and_edited_copies(spark, documents, monkeypatch, 500_000)


def edited(rng, copy):
    """Edits that leave few or no words of the item side by side."""
    kind = rng.randrange(6)
    if kind == 0:
        return [f"new{j}" if j % 3 == 2 else w for j, w in enumerate(copy)]
    if kind == 1:
        return [x for j, w in enumerate(copy) for x in (w, f"put{j}")]
    if kind == 2:
        return [w for j, w in enumerate(copy) if j % 3 != 1]
    if kind == 3:
        at = rng.randrange(len(copy) + 1)
        return [*copy[:at], *words(rng, rng.randrange(2 * len(copy) + 2)), *copy[at:]]
    share = rng.random() * 0.5
    changed = []
    for word in copy:
        if rng.random() >= share:
            changed.append(word)
        elif rng.random() < 0.5:
            changed += words(rng, rng.randint(1, 3))
    return changed


def test_every_third_word_replaced(spark, documents):
    rng = random.Random(11)
    item = words(rng, 60)
    third = [f"new{j}" if j % 3 == 2 else w for j, w in enumerate(item)]
    doubled = [x for j, w in enumerate(item) for x in (w, f"put{j}")]
    pairs = [(i, " ".join([*words(rng, 50), *c, *words(rng, 50)])) for i, c in enumerate([third, doubled])]
    got = found(documents(pairs), spark.createDataFrame([(1, " ".join(item), 1, 1)], ITEMS))
    assert got.keys() == {(0, 1), (1, 1)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_found_exactly_when_the_whole_text_says_so(spark, documents, seed):
    """Every item against every whole text by alignment alone; few different words, so that chance
    seeds are everywhere."""
    rng = random.Random(seed)
    some = words(rng, 60 * seed)
    items = {i: rng.choices(some, k=rng.randint(1, 45)) for i in range(25)}
    texts = {}
    for i in range(120):
        body = rng.choices(some, k=rng.randint(0, 120))
        for item in rng.choices(list(items.values()), k=2):
            at = rng.randrange(len(body) + 1)
            body[at:at] = edited(rng, item)
        texts[i] = body
    limits = decontam.Limits(0.5, 8, 13)
    expected = {}
    for d, text in texts.items():
        for i, item in items.items():
            a, b = (np.array([hash(w) for w in x], np.int64) for x in (item, text))
            score = decontam._found(a, b, np.zeros(len(b), bool), limits)[0]
            if score:
                expected[d, i] = score / len(item)
    pairs = [(d, " ".join(text)) for d, text in texts.items()]
    rows = [(i, " ".join(item), 1, 1) for i, item in items.items()]
    got = found(documents(pairs), spark.createDataFrame(rows, ITEMS))
    assert got.keys() == expected.keys()
    same = sum(abs(got[key].score - expected[key]) < 1e-9 for key in expected)
    assert same >= 0.97 * len(expected)  # equal alignments may be taken in another order


def test_no_alignment_scores_more_than_the_bound():
    rng = random.Random(8)
    for _ in range(300):
        item, passage = (
            np.array([rng.randrange(9) for _ in range(rng.randint(1, n))]) for n in (9, 60)
        )
        assert decontam.align(item, passage)[0] <= decontam.most(item, passage)


def test_odd_texts_and_short_items(spark, odd_documents):
    items = [(1, "text without", 1, 1), (2, "twice", 1, 1), (3, "never there", 1, 1)]
    got = found(odd_documents, spark.createDataFrame(items, ITEMS))
    assert got.keys() == {(None, 1), (5, 2)}
    rows = decontam.find_leaks(odd_documents, spark.createDataFrame(items, ITEMS))
    assert rows.count() == len(ODD_TEXTS)
    assert rows.select("doc.*").columns == odd_documents.columns


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], ITEMS)
    assert found(documents([(1, "a text")]), none) == {}
    assert found(documents([]), spark.createDataFrame([(1, "a text of words", 1, 1)], ITEMS)) == {}


def test_alignment_score_by_dynamic_programming():
    rng = random.Random(3)
    for _ in range(100):
        item, passage = ([rng.randrange(4) for _ in range(rng.randint(1, 9))] for _ in range(2))
        table = np.zeros((len(item) + 1, len(passage) + 1))
        for i, a in enumerate(item, 1):
            for j, b in enumerate(passage, 1):
                step = decontam.MATCH if a == b else decontam.MISMATCH
                gap = max(table[i - 1, j], table[i, j - 1]) + decontam.GAP
                table[i, j] = max(0, table[i - 1, j - 1] + step, gap)
        score, start, end = decontam.align(np.array(item), np.array(passage))
        assert score == table.max()
        assert 0 <= start <= end <= len(passage)

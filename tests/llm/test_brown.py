import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from odd_texts import ODD_TEXTS, look_alikes
from pyspark.sql import functions as F

from switchboard.llm import brown
from switchboard.llm.words import split_words


def held_out():
    return F.coalesce(F.col("doc_id") % 10 == 0, F.lit(False))


def tokens(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


def check_counts(rows, pairs):
    counts = Counter()
    for doc_id, text in pairs:
        if doc_id is None or doc_id % 10:
            counts.update(tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    expected, got = [], []
    for doc_id, text in pairs:
        found = tokens(text)
        logs = [math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in found]
        known = sum(counts[t] > 0 for t in found)
        held = doc_id is not None and doc_id % 10 == 0
        expected.append((str(doc_id), held, len(found), known, total, f"{sum(logs):.3f}"))
    for r in rows:
        got.append((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.3f}"))
    assert sorted(got) == sorted(expected)


def test_counts_and_unigram_scores(documents):
    rng = random.Random(3)
    pool = ["the", "The", "of", "and", "día", "x", "rare"] + [f"w{i}" for i in range(60)]
    pairs = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 50)))) for i in range(100)]
    pairs.append((10, pairs[10][1]))
    check_counts(brown.score_texts(documents(pairs), held_out(), classes=8).collect(), pairs)


def test_classes_tell_word_order(documents):
    """Nouns follow articles; a text in that order is likelier than the same words shuffled."""
    rng = random.Random(4)
    articles, nouns, verbs = ([f"{k}{i}" for i in range(12)] for k in "anv")

    def sentence():
        return [w for _ in range(10) for w in (rng.choice(articles), rng.choice(nouns), rng.choice(verbs))]

    pairs = [(10 * i + 1, " ".join(sentence())) for i in range(150)]
    ordered = sentence()
    shuffled = sorted(ordered, key=lambda w: rng.random())
    pairs += [(10, " ".join(ordered)), (20, " ".join(shuffled)), (30, "unseen words only")]
    rows = {r.doc_id: r for r in brown.score_texts(documents(pairs), held_out(), classes=8).collect()}
    assert rows[10].score > rows[20].score + 5
    assert rows[10].score > rows[10].base_score + 5
    assert rows[30].n_known == 1 and rows[30].score < 0


def test_words_beside_no_frequent_word_have_contexts(documents):
    """Words that alternate, and never stand beside one of the most frequent words."""
    rng = random.Random(5)
    fillers = [f"f{i}" for i in range(brown.CONTEXTS + 16)]
    left, right = ([f"{side}{i}" for i in range(10)] for side in "lr")
    pairs = [(10 * i + 1, " ".join(3 * fillers)) for i in range(200)]
    for i in range(40):
        inner = " ".join(f"{rng.choice(left)} {rng.choice(right)}" for _ in range(12))
        pairs.append((10 * i + 2, f"begin {inner} end"))
    ordered = " ".join(f"{one} {two}" for one, two in zip(left, right))
    pairs += [(10, f"begin {ordered} end"), (20, f"begin {' '.join(left + right)} end")]
    rows = {r.doc_id: r for r in brown.score_texts(documents(pairs), held_out()).collect()}
    assert rows[10].n_known == rows[20].n_known == 23
    assert rows[10].score > rows[20].score + 3


def test_every_word_is_a_context(documents):
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(60)]
    hashes = {w: int(split_words(pa.array([w])).hashes[0]) for w in pool} | {None: int(brown.END)}
    word_class = {h: h % 7 for h in hashes.values()}
    expected = Counter()
    for text in texts:
        found = [hashes[t] for t in tokens(text)]
        for before, word in zip([int(brown.END), *found], found):
            expected.update([(word, 0), (word, 1 + word_class[before]), (before, 8 + word_class[word])])
    docs = documents(list(enumerate(texts)))
    signed = [(h - 2**64 if h >= 2**63 else h, 1, c) for h, c in word_class.items()]
    known = docs.sparkSession.createDataFrame(signed, "word long, n long, word_class short")
    got = Counter()
    for batch in brown._class_vectors(docs, known, 3, 7).toArrow().combine_chunks().to_batches():
        words, codes, n = brown._unpacked(batch)
        got.update({(int(w), int(c)): int(k) for w, c, k in zip(words, codes, n) if c < 15})
    assert got == expected


def test_counting_classes_holds_little_more_than_the_chunk():
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.2, 300) % 100_000) for _ in range(2_000)]
    hashes = np.unique(np.append(split_words(pa.array(texts)).hashes, brown.END))
    answers = {"word": hashes.view(np.int64), "n": hashes % 9, "word_class": (hashes % 64).astype(np.int16)}
    chunk = pa.table({"text": texts})
    tracemalloc.start()
    vectors = brown._count_classes(chunk, pa.table(answers), 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(vectors.column("word").to_numpy().view(np.uint64) != hashes) == 0
    assert max(b.num_rows for b in vectors.to_batches()) <= brown.VECTORS < len(hashes)
    # Three numbers of 4 bytes a token, twice, and a slice of text: 48 bytes; it was 118.
    assert peak < 70 * 301 * len(texts)


def test_choosing_classes_holds_no_row_of_classes_for_each_context():
    rng = np.random.default_rng(8)
    n_words, contexts, classes = 3_000, 64, 64
    codes = np.concatenate([[0], np.arange(1, 1 + 2 * contexts)])
    words = np.repeat(np.arange(n_words).astype(np.uint64), len(codes))
    counts = rng.integers(1, 9, len(words))
    batch = brown._vectors(words, np.tile(codes, n_words), counts)
    model = brown._log_weights(rng.integers(0, 50, (classes, len(codes))).astype(float), contexts)
    tracemalloc.start()
    found, rows, own, n = brown._classes_of(batch, model, classes, contexts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for word in range(0, n_words, 100):
        by_hand = counts.reshape(n_words, -1)[word] @ model[2:].T
        assert math.isclose(by_hand[found[word] - 2], by_hand.max())
    # Some numbers of 8 bytes for each context; 62 and more were held before.
    assert len(rows) == len(own) == len(n) == n_words * 2 * contexts
    assert peak < 20 * 8 * len(n)


def test_probabilities_sum_to_one(spark):
    rows = [(1, False, 3, 3, 0.0, 0.0, bytes([2, 3 + brown.RARE, 0]))]
    sequences = spark.createDataFrame(rows, brown.SEQUENCE)
    sizes = np.array([1, 0, 1, 1, 0], float)
    chances = 10 ** brown._transitions(sequences, 4, 3, 1, sizes)
    used = [0, 1, 2, 3, brown.UNKNOWN]
    assert np.allclose(chances[used][:, used].sum(1), 1)


def test_odd_texts(odd_documents):
    check_counts(brown.score_texts(odd_documents, held_out(), classes=4).collect(), ODD_TEXTS)


def test_no_training_rows_and_empty_table(documents):
    rows = brown.score_texts(documents([(10, "some words")]), held_out()).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows] == [(3, 0, 0, 0, 0)]
    assert brown.score_texts(documents([]), held_out()).count() == 0


def test_long_words_that_look_alike(documents):
    one, two = look_alikes(1_024)
    pairs = [(1, f"{one} x"), (2, f"{two} y"), (10, f"{one} {two}"), (20, look_alikes(4_096)[1])]
    check_counts(brown.score_texts(documents(pairs), held_out(), classes=4).collect(), pairs)

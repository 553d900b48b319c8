import random
import re

import numpy as np
import pytest
from odd_texts import LONG, ODD_TEXTS
from pyspark.sql import functions as F

from switchboard.llm import periodic
from switchboard.llm.periodic import Extensions, find_runs, planted, runs_of


def expected_runs(words, min_length):
    """Maximal stretches for every period; of equal stretches the smallest period counts."""
    found = {}
    for period in range(1, len(words) // 2 + 1):
        start = 0
        while start + period < len(words):
            stop = start
            while stop + period < len(words) and words[stop] == words[stop + period]:
                stop += 1
            if stop > start:
                length = stop - start + period
                if length >= max(min_length, 2 * period):
                    found.setdefault((start, length), period)
                start = stop
            else:
                start += 1
    return sorted((s, n, p) for (s, n), p in found.items())


def expected_answer(text, min_length=12):
    if text == LONG:  # one word again and again, then a very long one
        return [(0, 60_000, 1)], "word " + "x" * 200_000
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = sorted(expected_runs(words, min_length), key=lambda r: (r[0], r[2]))
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in dropped)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("at_once", [7, 1 << 20])
def test_runs_against_every_period(seed, at_once, monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS_AT_ONCE", at_once)
    rng = random.Random(seed)
    for _ in range(25):
        rows = []
        for _ in range(rng.randint(1, 6)):
            n = rng.choice([0, 1, 3, 11, 12, 13, 40, 120])
            words = [rng.randrange(rng.randint(1, 4)) for _ in range(n)]
            if rng.random() < 0.5:
                words = [words[i] for i in planted(n, 10 * rng.randrange(10**6))]
            rows.append(words)
        least = rng.choice([1, 2, 3, 4, 12])
        bounds = np.cumsum([0, *map(len, rows)])
        codes = np.array([w for row in rows for w in row], np.int64)
        got = [[] for _ in rows]
        for row, *run in zip(*(c.tolist() for c in runs_of(codes, bounds, least))):
            got[row].append(tuple(run))
        for words, runs in zip(rows, got):
            assert runs == sorted(expected_runs(words, least), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 50])
def test_common_extensions_of_all_places(letters):
    rng = random.Random(letters)
    codes = [rng.randrange(letters) for _ in range(60)] * 3
    codes[100] = letters
    one, two = (x.ravel() for x in np.indices((len(codes), len(codes))))
    one, two = one[one != two], two[one != two]
    found = Extensions(np.array(codes)).longest(one, two)
    for i, j, n in zip(one.tolist(), two.tolist(), found.tolist()):
        assert codes[i : i + n] == codes[j : j + n]
        assert max(i, j) + n == len(codes) or codes[i + n] != codes[j + n]


def test_planted_places():
    assert planted(6, 11).tolist() == [0, 1, 2, 3, 4, 5]
    # At word 2 of 10, with a period of 1 + 8 // 3.
    assert planted(10, 10 * 72).tolist() == [0, 1, 2, 3, 4, 2, 3, 4, 2, 3]


TEXTS = [
    *ODD_TEXTS,
    (7, "a b " * 9 + "c"),
    (8, "x " * 11),
    (9, "x\n" * 12),
    (10, "é è e " * 4 + "one two three four five six seven " * 2),
    (11, "a a b " * 6 + "b b a a b a " * 5),
]


def test_table(documents):
    found = find_runs(documents(TEXTS)).collect()
    got = sorted((repr(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in found)
    assert got == sorted((repr(i), *expected_answer(text)) for i, text in TEXTS)


def test_planted_table(documents):
    pairs = [(i, " ".join(f"w{j}" for j in range(40))) for i in range(60)] + [(None, "a b")]
    docs = documents(pairs)
    plant = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = {r.doc_id: r for r in find_runs(docs, plant=plant).collect()}
    import zlib

    for i, text in pairs:
        words, number = text.split(), 1 if i is None else zlib.crc32(str(i).encode())
        repeated = " ".join(words[j] for j in planted(len(words), number))
        runs, collapsed = expected_answer(repeated)
        assert ([tuple(x) for x in found[i].runs], found[i].collapsed) == (runs, collapsed)
    assert any(len(r.runs) for r in found.values())


def test_empty_table(documents):
    assert find_runs(documents([])).count() == 0

import random
from collections import Counter

import pyarrow as pa
import pytest
from odd_texts import ODD_TEXTS

from switchboard.llm import suffix_dedup
from switchboard.llm.suffix_dedup import LEAD, cut_repeats


def expected(pairs, length):
    rows = {pair: (pair[1] or "").encode() for pair in pairs}  # equal rows are one text
    starts = Counter(b[i : i + length] for b in rows.values() for i in range(len(b) - length + 1))
    result = []
    for pair in pairs:
        data = rows[pair]
        covered = bytearray(len(data) + 1)
        for i in range(len(data) - length + 1):
            if starts[data[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        spans, start = [], None
        for i, x in enumerate(covered):
            if x and start is None:
                start = i
            if not x and start is not None:
                spans.append((start, i))
                start = None
        kept = bytes(c for c, x in zip(data, covered) if not x)
        result.append((pair[0], len(data), tuple(spans), kept))
    return Counter(result)


def found(docs, length, **more):
    return Counter(
        (row.doc_id, row.n_bytes, tuple(map(tuple, row.spans)), bytes(row.kept))
        for row in cut_repeats(docs, length, **more).collect()
    )


def texts(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abcé ", k=rng.randint(30, 150))) for _ in range(5)]
    pairs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append("".join(rng.choices("abcé ", k=rng.randint(0, 60))))
            passage = rng.choice(passages)
            cut = rng.randint(0, len(passage))
            parts.append(rng.choice([passage, passage[cut:], passage[:cut], "ab" * 40, ""]))
        pairs.append((i, "".join(parts)))
    return pairs + [(70, pairs[3][1]), (71, pairs[3][1]), (3, pairs[3][1])]


@pytest.mark.parametrize(("seed", "length"), [(1, LEAD + 1), (2, 40), (3, 64)])
def test_against_all_strings(documents, seed, length):
    assert found(documents(texts(seed)), length) == expected(texts(seed), length)


@pytest.mark.parametrize("group", [1, 4])
def test_large_groups_are_dealt_by_window(documents, group):
    assert found(documents(texts(4)), 48, group=group) == expected(texts(4), 48)


@pytest.mark.parametrize("group", [4, 20_000])
def test_a_group_larger_than_a_part(spark, documents, group):
    rng = random.Random(5)
    lead = "".join(rng.choices("xyzé", k=45))
    around = ["".join(rng.choices("abc ", k=60)) for _ in range(400)]
    pairs = [(i, around[i] + lead + around[i // 2]) for i in range(400)]
    assert found(documents(pairs), 48, group=group) == expected(pairs, 48)


def test_groups_over_parts_go_by_window_only():
    text = "".join(random.Random(6).choices("abc", k=100))
    kinds = [suffix_dedup.OPEN | more for more in (0, suffix_dedup.MANY, suffix_dedup.EDGE_OF_PART)]
    kinds.append(kinds[1] | kinds[2])
    kind = pa.list_(pa.struct([("at", pa.int32()), ("lead", pa.int64()), ("kind", pa.int32())]))
    marks = [{"at": 20 + k, "lead": k, "kind": kind} for k, kind in enumerate(kinds)]
    batch = pa.RecordBatch.from_pydict(
        {"text": pa.array([text]), "row": pa.array([1]), "marks": pa.array([marks], kind)}
    )
    sent = [row for b in suffix_dedup._surroundings(iter([batch]), 48) for row in b.to_pylist()]
    assert [r["at"] for r in sent if r["sort"] == suffix_dedup.SURROUNDINGS] == [20]
    windows = sum(row["sort"] == suffix_dedup.WINDOW for row in sent)
    assert windows == 3 * (48 - LEAD + 1)


def test_odd_texts(odd_documents):
    pairs = [(i, t) for i, t in ODD_TEXTS]
    assert found(odd_documents, 40) == expected(pairs, 40)


def test_empty_table(documents):
    assert found(documents([]), 200) == Counter()

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from odd_texts import ODD_TEXTS
from tokenizers import Tokenizer

from switchboard.llm.packing import LONG_BLANK, SumOfSquares, has_long_blank, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, pairs, capacity):
    """Every document is whole, every sequence gapless and within the capacity."""
    wanted = defaultdict(list)
    for doc_id, text in pairs:
        wanted[doc_id].append(ids_of(text))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for row in rows:
        pieces[row.doc_id].append(row)
        sequences[row.sequence_id].append(row)
    assert pieces.keys() == wanted.keys()
    for doc_id, texts in wanted.items():
        assert sum(r.length for r in pieces[doc_id]) == sum(map(len, texts))
        for row in pieces[doc_id]:
            fits = [t for t in texts if len(t) == row.doc_tokens]
            crc = [zlib.crc32(np.array(t[row.start : row.start + row.length], "<u4").tobytes()) for t in fits]
            assert row.ids_crc32 in crc
        if len(texts) == 1:
            at = 0
            for row in sorted(pieces[doc_id], key=lambda r: r.start):
                assert row.start == at
                at += row.length
            assert at == len(texts[0])
    padded = 0
    for rows in sequences.values():
        at = 0
        for row in sorted(rows, key=lambda r: r.offset):
            assert row.offset == at
            at += row.length
        assert at <= capacity and all(r.sequence_length == at for r in rows)
        padded += 0 if at & (at - 1) == 0 else capacity - at
    assert padded == 0


def test_round_trip(documents):
    rng = random.Random(2)
    pairs = [(i, " ".join(rng.choices(["the", "packing", "égal", "x1"], k=rng.randint(0, 300)))) for i in range(80)]
    pairs.append((90, "before<|endoftext|>after"))
    check(pack(documents(pairs), capacity=128).collect(), pairs, 128)


def test_odd_texts(odd_documents):
    check(pack(odd_documents).collect(), ODD_TEXTS, 2048)


def test_empty_table(documents):
    assert pack(documents([])).count() == 0


def test_level_with_the_smallest_sum_of_squares():
    rng = random.Random(3)
    packer = SumOfSquares(32, 0)
    counts = [0] * 33
    for i in range(400):
        size = rng.randint(1, 31)
        best = None
        for level in range(32 - size + 1):
            if level and not counts[level]:
                continue
            after = list(counts)
            if level:
                after[level] -= 1
            if level + size < 32:
                after[level + size] += 1
            cost = sum(n * n for n in after)
            if best is None or cost < best[0]:
                best = (cost, after)
        counts = best[1]
        packer.add(i, np.zeros(size, "<u4"))
        assert sum(int(n) ** 2 for n in packer.counts) == best[0]
        counts = packer.counts.tolist()


def test_long_runs_of_white_space(documents):
    runs = [c * 1_000_000 for c in " \t\n\u00a0"] + [" \n" * 500_000, "a" + " " * 800_000 + "b"]
    pairs = list(enumerate(runs))
    check(pack(documents(pairs)).collect(), pairs, 2048)


def test_long_blanks_are_noticed_wherever_they_are():
    for begin in range(0, 2 * LONG_BLANK, 777):
        assert has_long_blank("a" * begin + " " * LONG_BLANK)
        assert has_long_blank("a" * begin + "\u3000" * LONG_BLANK + "b" * begin)
    assert not has_long_blank("a b\n" * LONG_BLANK)
    assert not has_long_blank("")

import hashlib
import random
import re

import numpy as np
import pytest
from odd_texts import ODD_TEXTS
from pyspark.sql import functions as F

from switchboard.llm.fill_middle import BlockIndex, fill_in_middle, restore

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]", re.DOTALL)


def expected(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    tokens = TOKEN.findall(text)
    low, high = sorted(x % (len(tokens) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(tokens[slice(*s)]) for s in ((0, low), (low, high), (high, None)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    form = "spm" if h[3] % 100 < 20 else "psm"
    parts = [f"<P>{prefix}", f"<S>{suffix}"]
    output = "".join(parts if form == "psm" else parts[::-1]) + f"<M>{middle}"
    return len(tokens), form, len(prefix), len(middle), output


TEXTS = [
    *ODD_TEXTS,
    (7, "<P>"),
    (8, "a <S> b"),
    (9, "<P <M < P> <S"),
    (10, "A"),
    (11, "\U0001f600" * 700),
    (12, "nul \x00 in it, and a   line"),
    *((i, f"text {i}: <S, two words & more>" * (i % 5)) for i in range(20, 140)),
]


def test_table(documents):
    found = fill_in_middle(documents(TEXTS))
    found = found.withColumn("restored", restore(F.col("output"), F.col("form"))).collect()
    columns = ("n", "form", "prefix_chars", "middle_chars", "output")
    got = sorted((repr(r.doc_id), r.restored, repr([r[c] for c in columns])) for r in found)
    assert got == sorted((repr(i), t or "", repr(list(expected(i, t)))) for i, t in TEXTS)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_empty_table(documents):
    assert fill_in_middle(documents([])).count() == 0


@pytest.mark.parametrize("block", [1, 3, 8, 512])
def test_every_cut_of_random_texts(block):
    rng = random.Random(block)
    for _ in range(40):
        text = "".join(rng.choice("abZ \né世\U0001f600<") for _ in range(rng.randrange(90)))
        index = BlockIndex(np.frombuffer(text.encode(), np.uint8), block)
        tokens = TOKEN.findall(text)
        assert index.n_tokens == len(tokens)
        for token in range(len(tokens) + 1):
            assert index.chars_before(token) == len("".join(tokens[:token]))

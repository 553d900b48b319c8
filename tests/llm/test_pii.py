import hashlib
import random
import re

from odd_texts import ODD_TEXTS
from pyspark.sql import functions as F

from switchboard.llm.pii import KINDS, digest, find_personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def base(text):
    spans = []
    for kind in KINDS:
        for match in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", match[0])
            if kind == "ip" and any(int(part) > 255 for part in match[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            spans.append((kind, match.start(), match.end()))
    return spans


def expected(pairs):
    rows = []
    for doc_id, text in pairs:
        spans = base(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = [sum(s[0] == kind for s in spans) for kind in KINDS]
        rows.append((doc_id, *counts, hashlib.sha256(joined.encode()).hexdigest(), joined))
    return sorted(rows, key=str)


def found(docs):
    return sorted(map(tuple, digest(docs, find_personal_data(docs)).collect()), key=str)


def test_random_texts(documents):
    rng = random.Random(1)
    pieces = [
        *("a@b.co", "x_y%z@mail-1.example.com", "@", ".", "..", "a.b", "_d@e.f", "-", " ", "\x01"),
        *("1.2.3.4", "256.1.1.1", "001.2.3.255", "10.0.0.1.9", "4111 1111 1111 1111", "é", "\U0001f600"),
        *("4111-1111-1111-1111", "5500000000000004", "1234567890123456", "0", "7", "+", "(", ")"),
        *("+1 (555) 010-9999", "+49 30 1234567", "+123", "word", "\n", "\t", "+1.2.3.4.5.6.7.8.9"),
    ]
    pairs = [(i, "".join(rng.choices(pieces, k=rng.randint(0, 14)))) for i in range(400)]
    assert found(documents(pairs)) == expected(pairs)


def test_odd_and_very_long_texts(documents):
    runs = ["1 " * 50_000, "9" * 60_000, "a." * 30_000 + "@" + "b." * 30_000, "a" * 100_000 + "@"]
    pairs = [*ODD_TEXTS, *enumerate(runs, 50), (60, "+" + "1-" * 40_000), (61, "a@b.c " * 3_000)]
    assert found(documents(pairs)) == expected(pairs)


def test_empty_table(documents):
    assert found(documents([])) == []


def test_patterns_find_addresses_without_at_or_digit(documents):
    pairs = [(i, f"please write to Mail: {c}{c}@example.com today") for i, c in enumerate("abcdefgh")]
    more = {50: "anna(at)example.com", 51: "anna[at]example.org"}
    pairs += [(i, f"or to Mail: {token}, thanks") for i, token in more.items()]
    pairs += [(60, "or to Mail: nobody, (at) last [at] all"), (61, "look anna(at)example.com, thanks")]
    spans = find_personal_data(documents(pairs))
    assert spans.where("base").count() == 8
    rows = spans.where(~F.col("base")).select("doc_id", "kind", "start", "end").collect()
    text = dict(pairs)
    assert {(r.doc_id, r.kind, text[r.doc_id][r.start : r.end]) for r in rows} == {
        (i, "email", token) for i, token in more.items()
    }


def test_patterns_find_unseen_identifiers(documents):
    numbers = [f"+49 30 {1234567 + i}" for i in range(20)]
    pairs = [(i, f"please call Hotline: {n} today") for i, n in enumerate(numbers)]
    pairs += [(50, "or Hotline: 030 7654321, thanks"), (51, "room 030 7654322, thanks")]
    pairs += [(52 + i, f"the code AB{i}17 is new") for i in range(20)]
    docs = documents(pairs)
    spans = find_personal_data(docs)
    assert spans.where("base").count() == 20
    more = spans.where(~F.col("base")).select("doc_id", "kind", "start", "end").collect()
    text = dict(pairs)[50]
    start = text.index("030")
    assert [tuple(row) for row in more] == [(50, "phone", start, start + len("030 7654321"))]
    assert dict((row[0], row[6]) for row in found(docs))[50] == f"phone:{start}:{start + 11}"

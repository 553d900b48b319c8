import random
from collections import Counter, defaultdict

from odd_texts import ODD_TEXTS
from pyspark.sql import functions as F

from switchboard.llm.line_dedup import dedup_lines

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def expected(pairs, min_chars, min_docs):
    holders = defaultdict(set)
    for doc_id, text in pairs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc_id)
    keeper = {
        k: max((h for h in held if h is not None), default=None)
        for k, held in holders.items()
        if len(held) >= min_docs
    }
    result = []
    for doc_id, text in pairs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == doc_id]
        result.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(result)


def found(docs, *args):
    rows = dedup_lines(docs, *args).select("doc.doc_id", "n_lines", "n_dropped", "kept").collect()
    return Counter(map(tuple, rows))


def test_random_lines(documents):
    rng = random.Random(1)
    pool = ["Alpha beta", "alpha BETA ", "\talpha beta\x0b", "ÉTÉ chaud", "été chaud", "", "x", "gamma"]
    pairs = [
        (rng.choice([i, i, 3, None]), "\n".join(rng.choices(pool, k=rng.randint(0, 6))))
        for i in range(60)
    ]
    assert found(documents(pairs), 5, 3) == expected(pairs, 5, 3)


def test_one_line_in_most_documents(documents):
    pairs = [(i, f"own line of {i}\nthe line that everyone has\nend") for i in range(200)]
    result = found(documents(pairs), 20, 3)
    assert result == expected(pairs, 20, 3)
    assert sum(n for (_, _, dropped, _), n in result.items() if dropped) == 199


def test_odd_texts(odd_documents):
    assert found(odd_documents, 3, 2) == expected(ODD_TEXTS, 3, 2)


def test_empty_table_and_kept_columns(documents):
    docs = documents([])
    result = dedup_lines(docs)
    assert result.select("doc.*").columns == docs.columns
    assert result.count() == 0
    one = dedup_lines(documents([(1, "a")])).select(F.col("doc.n")).first()
    assert one.n == 7

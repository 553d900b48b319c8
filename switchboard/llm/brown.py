"""Class-based bigram language model: words get classes by exchange clustering, and a text is
scored by class transitions and word emissions.

All corpus statistics come from whole training texts. The steps, each a Spark job:

1. Context words to begin with: every word that makes up at least ``MIN_SHARE`` of some slice of
   text is a candidate; the most frequent ``CONTEXTS`` of them are taken.
2. A vector per word: how often it occurs, and how often after and before each context word.
3. Exchange: class counts are frozen, every word moves to the class that gives its contexts the
   highest likelihood, counts are taken again; ``rounds`` times. The class of a word is a function
   of its vector and the frozen counts, so no table of classes is kept between rounds.
4. Texts are grouped into chunks of bounded size. Each chunk asks for its distinct words once and
   gets counts and classes back. The first time it counts for each word the classes beside it, so
   that every word is a context of its neighbours; the exchange is done again on these vectors.
5. The second time each chunk turns its texts into sequences of the new classes. Class transitions
   are summed over the training sequences, and all sequences are scored.

Only tables of at most classes x contexts numbers reach the driver or are sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchboard.llm.common import ask_small_batches, id_and_text, slices
from switchboard.llm.words import U64, Words, split_words
from switchboard.operators.skew import stored

CONTEXTS = 64
MIN_SHARE = 0.0005
CHUNK_BYTES = 24_000_000
# Words that make one batch of vectors.
VECTORS = 10_000
# Codes are below this, three to each context at most.
CODES = 1 << 10
# The token after the last word of a text; no hash of a word is looked up under it by chance
# more often than two words share a hash.
END = np.uint64(0xE9D0E9D0E9D0E9D0)
# Bytes of a class sequence: the class, with RARE added for words seen once; UNKNOWN otherwise.
RARE, UNKNOWN = 128, 127
# Fixed values of the unigram score: what is added to every count.
ADDED = 0.1
# Weight of the class frequencies in the class transitions.
PRIOR = 10.0

WORD_VECTOR = "word long, n long, contexts binary"


def score_texts(
    docs: DataFrame, held_out: Column, classes: int = 64, rounds: int = 4
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    Tokens are the words of the text and one end. ``base_score`` is the unigram score with 0.1
    added to every count, ``score`` the log10 probability under the class model. A word that the
    training texts lack is the one unknown word; its probability after a class is the share of
    words seen once there. Probabilities of known words and the unknown word sum to one.

    A null or empty text is the end alone. Rows are scored each for itself, also repeated ones,
    and all training rows count. Without training rows everything is unknown and scores 0. Other
    columns are ignored, and an empty table gives no rows.
    """
    if classes > UNKNOWN - 1:
        raise ValueError(f"at most {UNKNOWN - 1} classes")
    ask_small_batches(docs.sparkSession)
    rows = id_and_text(docs.withColumn("__held_out", held_out), "__held_out")
    rows = rows.withColumnRenamed("__held_out", "held_out")
    train = rows.where(~F.col("held_out")).select("text")
    contexts = _context_words(train)
    vectors = stored(_word_vectors(train, contexts), "word-vectors")
    sums = vectors.agg(F.count("*"), F.sum("n"), F.count_if(F.col("n") == 1)).first()
    n_words, n_tokens, n_once = (int(value or 0) for value in sums)
    known = _assigned(vectors, _exchange(vectors, classes, rounds, CONTEXTS), classes, CONTEXTS)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = max(1, -(-total // CHUNK_BYTES))
    vectors = stored(_class_vectors(rows.where(~F.col("held_out")), known, n_chunks, classes), "class-vectors")
    known = _assigned(vectors, _exchange(vectors, classes, rounds, classes), classes, classes)
    sizes = np.zeros(classes + 1)
    for row in known.groupBy("word_class").agg(F.sum("n").alias("n")).collect():
        sizes[row.word_class] = row.n
    sequences = stored(_sequences(rows, known, n_chunks, sizes, n_words, n_tokens), "sequences")
    log_next = _transitions(sequences, classes, n_tokens, n_once, sizes)
    return _scored(sequences, log_next, n_tokens)


# 1. Context words


def _context_words(train: DataFrame) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                tokens = _with_ends(split_words(part.column("text")))
                words, n = np.unique(tokens, return_counts=True)
                often = n >= MIN_SHARE * n.sum()
                yield _batch(word=words[often].view(np.int64), n=n[often])

    counts = train.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(CONTEXTS).collect()
    return [row.word for row in top]


def _with_ends(words: Words) -> np.ndarray:
    return np.insert(words.hashes, words.bounds[1:], END)


def _batch(**columns) -> pa.RecordBatch:
    arrays = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()}
    return pa.RecordBatch.from_pydict(arrays)


# 2. A vector per word


def _word_vectors(train: DataFrame, contexts: list[int]) -> DataFrame:
    sorted_contexts = np.sort(np.array(contexts, np.int64).view(U64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for part in slices(batch):
                words = split_words(part.column("text"))
                found.append(_pairs(words, sorted_contexts))
                size += len(words.data)
                if size >= CHUNK_BYTES:
                    yield from _packed(*(np.concatenate(parts) for parts in zip(*found)))
                    found, size = [], 0
        if found:
            yield from _packed(*(np.concatenate(parts) for parts in zip(*found)))

    return _merged(train.mapInArrow(count, WORD_VECTOR))


def _merged(vectors: DataFrame) -> DataFrame:
    """One vector per word, the sum of its vectors."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch])
            batch = table.combine_chunks().to_batches()[0] if table.num_rows else batch
            if not batch.num_rows:
                continue
            words = batch.column("word").to_numpy()
            done = int(np.searchsorted(words, words[-1]))  # the last word may go on
            held = batch.slice(done)
            if done:
                yield from _packed(*_unpacked(batch.slice(0, done)))
        if held is not None:
            yield from _packed(*_unpacked(held))

    dealt = vectors.repartition("word").sortWithinPartitions("word")
    return dealt.mapInArrow(merge, WORD_VECTOR)


def _pairs(words: Words, contexts: np.ndarray):
    """Counted (word, code): code 0 for the word itself, 1 + i after and CONTEXTS + 1 + i before
    context word i. The end of a text is its own context, also of the first word."""
    distinct, tokens = np.unique(_with_ends(words), return_inverse=True)
    begins = words.bounds[:-1] + np.arange(words.n_rows)
    before = np.concatenate([tokens[-1:], tokens[:-1]])
    before[begins] = np.searchsorted(distinct, END)
    # A word and a code as one number, the word by its place among the distinct ones.
    width = 1 + 2 * CONTEXTS
    keys = [tokens * width]
    if len(contexts):
        at = np.minimum(np.searchsorted(contexts, distinct), len(contexts) - 1)
        code = np.where(contexts[at] == distinct, at, -1)
        for near, owner, base in ((before, tokens, 1), (tokens, before, 1 + CONTEXTS)):
            hit = code[near] >= 0
            keys.append(owner[hit] * width + code[near[hit]] + base)
    keys, n = np.unique(np.concatenate(keys), return_counts=True)
    return distinct[keys // width], keys % width, n


def _packed(words: np.ndarray, codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Vectors of the words in order, whatever the order of their counts, each in one row."""
    distinct, place = np.unique(words, return_inverse=True)
    keys = place * CODES + codes
    del place
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    n = np.add.reduceat(n[order], first) if len(first) else n[:0]
    del order
    keys = keys[first]
    for start in range(0, len(distinct), VECTORS):
        low, high = np.searchsorted(keys, [start * CODES, (start + VECTORS) * CODES])
        own = keys[low:high]
        yield _vectors(distinct[own // CODES], own % CODES, n[low:high])


def _vectors(words: np.ndarray, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row per word, from counts in order of word and code. Each entry of ``contexts`` is 8
    bytes: the code above a 48-bit count."""
    own = codes == 0
    entries = ((codes.astype(U64) << U64(48)) | n.astype(U64))[~own]
    first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]) if len(words) else [])
    distinct = words[first]
    totals = np.zeros(len(distinct), np.int64)
    totals[np.searchsorted(distinct, words[own])] = n[own]
    ends = np.searchsorted(words[~own], distinct, "right")
    offsets = pa.py_buffer(np.concatenate([[0], ends * 8]).astype(np.int32).tobytes())
    data = pa.py_buffer(entries.tobytes())
    binary = pa.Array.from_buffers(pa.binary(), len(distinct), [None, offsets, data])
    return _batch(word=distinct.view(np.int64), n=totals, contexts=binary)


def _entries(batch: pa.RecordBatch):
    """(row, code, count) of all context entries of a batch of word vectors."""
    column = batch.column("contexts")
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets) // 8)
    entries = np.zeros(0, U64)
    if len(rows):
        entries = np.frombuffer(column.buffers()[2], U64, len(rows), int(offsets[0]))
    counts = entries & U64((1 << 48) - 1)
    return rows, (entries >> U64(48)).astype(np.int64), counts.astype(np.int64)


def _unpacked(batch: pa.RecordBatch):
    words, n = (batch.column(c).to_numpy() for c in ("word", "n"))
    words = words.view(U64)
    rows, codes, counts = _entries(batch)
    return (
        np.concatenate([words, words[rows]]),
        np.concatenate([np.zeros(len(words), np.int64), codes]),
        np.concatenate([n, counts]),
    )


# 3. Exchange

# Class 0 holds the end of a text alone. Words that never stand beside a context word are dealt
# over the classes by their hash.


def _exchange(vectors: DataFrame, classes: int, rounds: int, contexts: int) -> np.ndarray | None:
    """Log weights (class, 1 + code) of the last frozen counts; column 0 is the class size."""
    model = None
    width = 1 + 2 * contexts
    for _ in range(rounds):

        def run(batches, model=model):
            sums = np.zeros((classes, width))
            for batch in batches:
                found, rows, codes, n = _classes_of(batch, model, classes, contexts)
                for c, own, k in ((found, 0, batch.column("n").to_numpy()), (found[rows], codes, n)):
                    sums += np.bincount(c * width + own, k, sums.size).reshape(sums.shape)
            at = np.nonzero(sums)
            yield _batch(c=at[0], code=at[1], n=sums[at])

        counts = vectors.mapInArrow(run, "c long, code long, n double").groupBy("c", "code")
        sums = np.zeros((classes, width))
        for row in counts.agg(F.sum("n").alias("n")).collect():
            sums[row.c, row.code] = row.n
        model = _log_weights(sums, contexts)
    return model


def _log_weights(sums: np.ndarray, contexts: int) -> np.ndarray:
    """Weights whose sum over a word's contexts is its log likelihood in a class: of the class
    given the word before, and of the word after given the class."""
    after, before = sums[:, 1 : 1 + contexts] + 0.1, sums[:, 1 + contexts :] + 0.1
    return np.hstack(
        [
            -np.log(sums[:, :1] + 1.0),
            np.log(after / after.sum(0, keepdims=True)),
            np.log(before / before.sum(1, keepdims=True)),
        ]
    )


def _classes_of(
    batch: pa.RecordBatch, model: np.ndarray | None, classes: int, contexts: int
):
    """The class of each word of a batch, and the context entries of the batch."""
    words, totals = (batch.column(c).to_numpy() for c in ("word", "n"))
    rows, codes, n = _entries(batch)
    begins = codes > 2 * contexts
    begin_rows, begin_classes = rows[begins], codes[begins] - 1 - 2 * contexts
    rows, codes, n = rows[~begins], codes[~begins], n[~begins]
    found = np.ones(batch.num_rows, np.int64)
    free = np.arange(2, classes)
    if len(free):
        found = free[(words.view(U64) % U64(len(free))).astype(np.int64)]
    if len(rows) and len(free):
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        if model is None and len(begin_rows):
            found[begin_rows] = begin_classes
        elif model is None:
            # To begin with, words go by the context they have most often.
            order = np.lexsort((-n, rows))
            found[rows[first]] = free[codes[order][first] % len(free)]
        else:
            beside = rows[first]
            counts = np.zeros((len(beside), model.shape[1]))
            counts[:, 0] = totals[beside]
            counts[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows)))), codes] = n
            # Classes that fit alike but for the order of the sum are alike: the first counts.
            found[beside] = free[np.round(counts @ model[2:].T, 6).argmax(1)]
    found[words.view(U64) == END] = 0
    return found, rows, codes, n


def _assigned(
    vectors: DataFrame, model: np.ndarray | None, classes: int, contexts: int
) -> DataFrame:

    def run(batches):
        for batch in batches:
            found = _classes_of(batch, model, classes, contexts)[0].astype(np.int16)
            yield _batch(word=batch.column("word"), n=batch.column("n"), word_class=found)

    return vectors.mapInArrow(run, "word long, n long, word_class short")


# 4. Sequences of classes

SEQUENCE = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, "
    "emission double, classes binary"
)


def _with_answers(rows: DataFrame, known: DataFrame, n_chunks: int):
    """The texts dealt into chunks, and for each chunk what is known of its words, as groups."""
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks))
    dealt = rows.withColumn("chunk", chunk).repartition("chunk")

    def ask(batches):
        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            found = []
            for part in slices(batch):
                words = split_words(part.column("text"))
                own = part.column("chunk").to_numpy()
                tokens, at = words.hashes, own[words.rows]
                asked = [np.unique(tokens[at == c]) for c in np.unique(own)]
                found += list(zip(np.unique(own), asked))
            for c in np.unique(chunks):
                asked = np.unique(np.concatenate([[END], *(w for at, w in found if at == c)]))
                yield _batch(chunk=np.full(len(asked), c), word=asked.view(np.int64))

    # All columns, so that this and the last step read the same exchange of texts.
    asked = dealt.mapInArrow(ask, "chunk long, word long")
    return dealt, asked.distinct().join(known, "word").groupBy("chunk")


def _class_vectors(
    train: DataFrame, known: DataFrame, n_chunks: int, classes: int
) -> DataFrame:
    """Word vectors whose contexts are the classes of all words that stand beside a word: code
    1 + c after and classes + 1 + c before a word of class c. Behind these stands the code of the
    word's own class, from which it goes on."""
    dealt, answers = _with_answers(train, known, n_chunks)

    def count(texts: pa.Table, answers: pa.Table) -> pa.Table:
        return _count_classes(texts, answers, classes)

    grouped = dealt.groupBy("chunk").cogroup(answers)
    return _merged(grouped.applyInArrow(count, WORD_VECTOR))


def _count_classes(texts: pa.Table, answers: pa.Table, classes: int) -> pa.Table:
    vocabulary, _, word_classes = _by_word(answers)
    end = np.searchsorted(vocabulary, END)
    # A word and a code as one number, the word by its place in the vocabulary. All numbers of the
    # chunk are sorted in place, and what is made of them is made for some words at a time.
    width = 1 + 3 * classes
    number = np.uint32 if len(vocabulary) * width < 1 << 32 else np.int64
    found = [(np.arange(len(vocabulary)) * width + 1 + 2 * classes + word_classes).astype(number)]
    for batch in texts.to_batches():
        for part in slices(batch):
            words = split_words(part.column("text"))
            at = np.searchsorted(vocabulary, _with_ends(words))
            before = np.concatenate([[end], at[:-1]])
            before[words.bounds[:-1] + np.arange(words.n_rows)] = end
            after_word = at * width + 1 + word_classes[before]
            before_word = before * width + 1 + classes + word_classes[at]
            found += [keys.astype(number) for keys in (at * width, after_word, before_word)]
    keys = np.concatenate(found)
    del found
    keys.sort()
    made = []
    for start in range(0, len(vocabulary), VECTORS):
        stop = min(start + VECTORS, len(vocabulary))
        low, high = np.searchsorted(keys, np.array([start * width, stop * width], number))
        own, n = np.unique(keys[low:high], return_counts=True)
        own = own.astype(np.int64)
        made.append(_vectors(vocabulary[own // width], own % width, n))
    return pa.Table.from_batches(made)


def _by_word(answers: pa.Table):
    """Words in order, with their counts and classes."""
    words = answers.column("word").to_numpy().view(U64)
    order = np.argsort(words)
    counts = answers.column("n").to_numpy()[order]
    return words[order], counts, answers.column("word_class").to_numpy()[order].astype(np.int64)


def _sequences(
    rows: DataFrame,
    known: DataFrame,
    n_chunks: int,
    sizes: np.ndarray,
    n_words: int,
    n_tokens: int,
) -> DataFrame:
    dealt, answers = _with_answers(rows, known, n_chunks)
    log_sizes = np.log10(np.maximum(sizes, 1))
    log_base = np.log10(n_tokens + ADDED * (n_words + 1))

    def encode(texts: pa.Table, answers: pa.Table) -> pa.Table:
        vocabulary, counts, classes = _by_word(answers)
        made = []
        for batch in texts.to_batches():
            for part in slices(batch):
                tokens = _with_ends(words := split_words(part.column("text")))
                at = np.searchsorted(vocabulary, tokens)
                at[at == len(vocabulary)] = 0
                hit = vocabulary[at] == tokens if len(vocabulary) else np.zeros(len(tokens), bool)
                n = np.zeros(len(tokens), np.int64)
                n[hit] = counts[at[hit]]
                codes = np.full(len(tokens), UNKNOWN, np.uint8)
                codes[hit] = classes[at[hit]] + RARE * (n[hit] == 1)
                emission = np.zeros(len(tokens))
                emission[hit] = np.log10(n[hit]) - log_sizes[classes[at[hit]]]
                ends = (words.bounds + np.arange(words.n_rows + 1)).astype(np.int64)
                first = ends[:-1]
                parts = (ends.astype(np.int32), codes)
                binary = [None, *(pa.py_buffer(part.tobytes()) for part in parts)]
                made.append(
                    _batch(
                        doc_id=part.column("doc_id"),
                        held_out=part.column("held_out"),
                        n_tokens=np.diff(ends),
                        n_known=np.add.reduceat(hit.astype(np.int64), first),
                        base_score=np.add.reduceat(np.log10(n + ADDED) - log_base, first),
                        emission=np.add.reduceat(emission, first),
                        classes=pa.Array.from_buffers(pa.binary(), words.n_rows, binary),
                    )
                )
        return pa.Table.from_batches(made)

    grouped = dealt.groupBy("chunk").cogroup(answers)
    return grouped.applyInArrow(lambda left, right: encode(left, right), SEQUENCE)


# 5. Transitions and scores


def _transitions(
    sequences: DataFrame, classes: int, n_tokens: int, n_once: int, sizes: np.ndarray
) -> np.ndarray:
    """log10 of the next class (columns; UNKNOWN: the unknown word) after a class (rows)."""
    train = sequences.where(~F.col("held_out")).select("classes")

    def count(batches):
        sums = np.zeros(256 * 256, np.int64)
        for batch in batches:
            before, codes, _ = _steps(batch.column("classes"))
            if len(codes):
                sums += np.bincount(before.astype(np.int64) * 256 + codes, minlength=256 * 256)
        at = np.flatnonzero(sums)
        yield _batch(step=at, n=sums[at])

    counted = train.mapInArrow(count, "step long, n long").groupBy("step")
    counted = counted.agg(F.sum("n").alias("n"))
    raw = np.zeros(256 * 256)
    for row in counted.collect():
        raw[row.step] = row.n
    raw = raw.reshape(2, 128, 2, 128)  # whether seen once, and class: before and after
    steps = raw.sum((0, 2))
    steps[UNKNOWN] = raw[1].sum((0, 1))  # words seen once stand for unknown words before
    once = raw[:, :, 1].sum((0, 2))
    once[UNKNOWN] = raw[1, :, 1].sum()
    overall = (n_once + 1) / (n_tokens + 2) if n_tokens else 1.0
    totals = steps.sum(1)
    unknown = (once + PRIOR * overall) / (totals + PRIOR)
    share = np.zeros(128)
    share[: classes + 1] = sizes / max(sizes.sum(), 1)
    chance = (steps + PRIOR * share) / (totals + PRIOR)[:, None]
    chance *= 1 - unknown[:, None]
    chance[:, UNKNOWN] = unknown
    return np.log10(np.maximum(chance, 1e-300))


def _steps(column: pa.Array):
    """(class before, class, row) of every token; before the first token stands an end."""
    lengths = np.array([len(value.as_buffer()) for value in column], np.int64)
    codes = np.frombuffer(b"".join(value.as_buffer() for value in column), np.uint8)
    before = np.concatenate([[0], codes[:-1]]).astype(np.uint8) if len(codes) else codes
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = 0
    return before, codes, np.repeat(np.arange(len(lengths)), lengths)


def _scored(sequences: DataFrame, log_next: np.ndarray, n_tokens: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            before, codes, rows = _steps(batch.column("classes"))
            logs = log_next[before & 127, codes & 127]
            sums = np.bincount(rows, logs, batch.num_rows)
            yield _batch(
                doc_id=batch.column("doc_id"),
                held_out=batch.column("held_out"),
                n_tokens=batch.column("n_tokens"),
                n_known=batch.column("n_known"),
                train_tokens=np.full(batch.num_rows, n_tokens),
                base_score=batch.column("base_score"),
                score=sums + batch.column("emission").to_numpy(),
            )

    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double"
    )
    return sequences.mapInArrow(run, schema)

"""Documents as token ids, packed into sequences of one length by the sum-of-squares rule."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from switchboard.llm.common import id_and_text

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_length long"
)
# Sequences that may be open in a task; beyond it they are filled up by cutting.
MAX_OPEN = 4_096
# White space in a row from which a text is read by the tokenizer itself.
LONG_BLANK = 10_000
# Sequence ids of a task begin at its number shifted by so many bits.
TASK_BITS = 36


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    ranks: str | None = None,
    capacity: int = 2048,
    end_id: int = 1,
) -> DataFrame:
    """One row per piece: where it comes from, and its sequence and place there.

    A document is its ids and ``end_id``. Whole windows of ``capacity`` ids become sequences of
    their own; the rest goes to the fill level that keeps the sum of squared counts of partially
    filled sequences smallest. Each task packs the rows it reads: no shuffle, memory for at most
    ``MAX_OPEN`` open sequences, and the same result if the task runs again. What is still open
    at the end of a task is filled up by cutting; the last ids go to sequences whose lengths are
    powers of two, so that nothing is padded.

    A null text is empty: a document of the end id alone. Repeated rows are packed each for
    itself, a null doc_id is carried, and an empty table gives no rows. Other columns are ignored.

    ``vocabulary`` is the tokenizer file and ``ranks`` the same vocabulary as ranks; the default
    is the 50k byte-level vocabulary of the machine's public tokenizers.
    """
    import public_tokenizers

    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        first = TaskContext.get().partitionId() << TASK_BITS
        packer = SumOfSquares(capacity, first)
        for batch in batches:
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text"))):
                packer.add(doc_id, np.append(encode(text), end_id).astype("<u4"))
            if batch.num_rows:
                yield packer.taken()
        packer.close()
        yield packer.taken()

    return id_and_text(docs).mapInArrow(run, SCHEMA)


def encoder(vocabulary: str, ranks: str):
    """Text to ids. The rank file gives the same ids several times faster; a text that spells a
    special token goes to the tokenizer itself, which reads it as that token, and so does a text
    with a long run of white space, for which the fast one needs a stack as deep as the run."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as lines:
        parts = [line.split() for line in lines]
    pairs = {base64.b64decode(token): int(rank) for token, rank in parts}
    fast = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={}
    )
    slow = Tokenizer.from_file(vocabulary)
    special = [token.content for token in slow.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(token in text for token in special) or has_long_blank(text):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def has_long_blank(text: str) -> bool:
    """Whether there are ``LONG_BLANK`` blanks in a row: half as many then follow some multiple of
    that half, and most multiples are no blanks themselves."""
    half = LONG_BLANK // 2
    return len(text) >= LONG_BLANK and any(
        text[i].isspace() and text[i : i + half].isspace() for i in range(0, len(text), half)
    )


class SumOfSquares:
    """The sequences of one task. ``counts[h]`` is the number of open sequences filled to ``h``."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.at_level: dict[int, list[list]] = {}
        self.n_open = 0
        self.next_id = first_id
        self.rows: list[tuple] = []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self._write([(doc_id, start, ids[start : start + self.capacity], len(ids))])
        if whole < len(ids):
            self._place((doc_id, whole, ids[whole:], len(ids)))

    def _place(self, piece: tuple) -> None:
        size, counts = len(piece[2]), self.counts
        levels = self.capacity - size + 1
        # Change of the sum of squares, halved and less one: a sequence leaves its level and
        # joins the next one; a full sequence is no longer counted, a new one leaves no level.
        change = counts[size:].copy() - counts[:levels]
        change[-1] = -counts[levels - 1] - 1
        change[counts[:levels] == 0] = np.iinfo(np.int64).max
        change[0] = counts[size]
        level = int(change.argmin())
        pieces = [piece]
        if level:
            pieces = [*self.at_level[level].pop(), piece]
            counts[level] -= 1
            self.n_open -= 1
        if level + size == self.capacity:
            self._write(pieces)
            return
        counts[level + size] += 1
        self.at_level.setdefault(level + size, []).append(pieces)
        self.n_open += 1
        if self.n_open > MAX_OPEN:
            self._fill_up(self.capacity)

    def _fill_up(self, least: int) -> None:
        """Cut the open pieces into full sequences; below ``least`` ids they stay open."""
        pieces = [p for at in sorted(self.at_level) for held in self.at_level[at] for p in held]
        self.at_level, self.n_open = {}, 0
        self.counts[:] = 0
        left = sum(len(p[2]) for p in pieces)
        pieces.reverse()
        while left >= least:
            size = min(self.capacity, 1 << (left.bit_length() - 1))
            self._write(_cut(pieces, size))
            left -= size
        if pieces:
            pieces.reverse()
            self.counts[left] = self.n_open = 1
            self.at_level[left] = [pieces]

    def close(self) -> None:
        self._fill_up(1)

    def _write(self, pieces: list[tuple]) -> None:
        offset, total = 0, sum(len(p[2]) for p in pieces)
        for doc_id, start, ids, doc_tokens in pieces:
            crc = zlib.crc32(ids.tobytes())
            place = (self.next_id, offset, total)
            self.rows.append((doc_id, start, len(ids), crc, doc_tokens, *place))
            offset += len(ids)
        self.next_id += 1

    def taken(self) -> pa.RecordBatch:
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        columns = list(zip(*self.rows)) or [[] for _ in names]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _cut(pieces: list[tuple], size: int) -> list[tuple]:
    """The last pieces of the list, ``size`` ids in all; the list loses them."""
    taken = []
    while size:
        doc_id, start, ids, doc_tokens = pieces.pop()
        if len(ids) > size:
            pieces.append((doc_id, start + size, ids[size:], doc_tokens))
            ids = ids[:size]
        taken.append((doc_id, start, ids, doc_tokens))
        size -= len(ids)
    return taken

"""Fill-in-the-middle: a text is cut at two of its tokens and its three parts change places.

Tokens are runs of ASCII letters and, one by one, all other code points. A cut is drawn as a number
of tokens, so its place has to be found in a text whose tokens and code points have no fixed
length. A Fenwick tree over blocks of equal length holds the tokens that begin in each block and
the code points in it; the descent by powers of two finds the block of a cut, and only that block
is looked at byte by byte. Parts, output and its inverse are built-in expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from switchboard.llm.common import id_and_text

# The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ANY_MARK = "<[PSM]>"
BLOCK_BYTES = 512
CUTS = StructType([StructField(name, LongType()) for name in ("n", "low", "high")])

LETTER = np.zeros(256, bool)
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1] = True


def fill_in_middle(
    docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document.

    ``n`` is the number of tokens. The form is ``plain`` (the text as it is), ``psm`` (prefix,
    suffix, middle) or ``spm`` (suffix, prefix, middle), each part after its mark; it and the two
    cuts are drawn from the hash of ``seed:doc_id``, so that a repeated task draws the same. A
    text that is empty or holds a mark stays plain. The lengths are in code points, null for plain.

    A null text is empty and a null id is drawn as an empty one. Repeated rows are cut alike, each
    for itself. Other columns are ignored, and an empty table gives no rows.
    """
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id), 256)
    rows = id_and_text(docs).select(
        "doc_id", "text", *(_drawn(digest, i).alias(f"h{i}") for i in range(1, 5))
    )
    found = rows.withColumn("cut", _cuts("text", "h1", "h2"))
    is_plain = (
        (F.col("text") == "")
        | F.col("text").rlike(ANY_MARK)
        | (F.col("h3") % 100 >= 100 - plain_percent)
    )
    form = F.when(is_plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    found = found.withColumn("form", form)
    low, high = F.col("cut.low"), F.col("cut.high")
    return found.select(
        "doc_id",
        F.col("cut.n").alias("n"),
        "form",
        F.when(F.col("form") != "plain", low).alias("prefix_chars"),
        F.when(F.col("form") != "plain", high - low).alias("middle_chars"),
        _output(F.col("text"), F.col("form"), low.cast("int"), high.cast("int")).alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` was given, from its output alone.

    A text with a mark is never cut, so the marks of an output are those that were set; two
    marks cannot overlap, so none is made where a part ends and a mark begins.
    """
    parts = F.split(output, ANY_MARK, -1)
    first, second, third = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return (
        F.when(form == "psm", F.concat(first, third, second))
        .when(form == "spm", F.concat(second, third, first))
        .otherwise(output)
    )


def _drawn(digest: Column, i: int) -> Column:
    """The ``i``-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")


def _output(text: Column, form: Column, low: Column, high: Column) -> Column:
    prefix = F.substring(text, F.lit(1), low)
    middle = F.substring(text, low + 1, high - low)
    suffix = F.substring(text, high + 1, F.length(text))
    prefix, suffix, middle = (
        F.concat(F.lit(mark), part)
        for mark, part in ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle))
    )
    return (
        F.when(form == "psm", F.concat(prefix, suffix, middle))
        .when(form == "spm", F.concat(suffix, prefix, middle))
        .otherwise(text)
    )


@F.arrow_udf(CUTS)
def _cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """Tokens of each text, and the code points before the smaller and the larger cut."""
    draws = zip(first.to_pylist(), second.to_pylist())
    found = []
    for text, numbers in zip(texts, draws):
        index = BlockIndex(np.frombuffer(text.as_buffer() or b"", np.uint8))
        low, high = sorted(number % (index.n_tokens + 1) for number in numbers)
        found.append((index.n_tokens, index.chars_before(low), index.chars_before(high)))
    columns = np.array(found, np.int64).reshape(-1, 3).T
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], CUTS.names)


class BlockIndex:
    """Tokens and code points of a text by blocks of ``block`` bytes, in a Fenwick tree.

    ``tree[i]`` holds the counts of the ``i & -i`` blocks that end with block ``i - 1``.
    """

    def __init__(self, data: np.ndarray, block: int = BLOCK_BYTES):
        self.block = block
        letters = LETTER[data]
        self.is_char = (data & 0xC0) != 0x80
        self.is_token = self.is_char.copy()
        self.is_token[1:] &= ~(letters[1:] & letters[:-1])
        self.n_blocks = -(-len(data) // block)
        counts = np.zeros((self.n_blocks + 1, 2), np.int64)
        if self.n_blocks:
            starts = np.arange(0, len(data), block)
            counts[1:, 0] = np.add.reduceat(self.is_token, starts, dtype=np.int64)
            counts[1:, 1] = np.add.reduceat(self.is_char, starts, dtype=np.int64)
        totals = counts.cumsum(axis=0)
        ends = np.arange(self.n_blocks + 1)
        self.tree = totals - totals[ends & (ends - 1)]
        self.n_tokens, self.n_chars = map(int, totals[-1])

    def chars_before(self, token: int) -> int:
        """Code points before token number ``token``; all of them where there is no such token."""
        if token >= self.n_tokens:
            return self.n_chars
        at, chars = 0, 0
        step = 1 << (self.n_blocks.bit_length() - 1)
        while step:
            if at + step <= self.n_blocks and self.tree[at + step, 0] <= token:
                at += step
                token -= int(self.tree[at, 0])
                chars += int(self.tree[at, 1])
            step >>= 1
        inside = slice(at * self.block, (at + 1) * self.block)
        place = np.flatnonzero(self.is_token[inside])[token]
        return chars + int(np.count_nonzero(self.is_char[inside][:place]))

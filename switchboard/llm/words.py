"""Words of whole texts as 64-bit hashes, computed for a batch at once.

Words are runs of bytes outside [\\x20\\x09-\\x0D], with A-Z lower-cased. The hash of a word is a
polynomial of its bytes modulo 2**64, taken from one running sum, then mixed. Such a polynomial is
blind to some differences between long words that repeat themselves by halves, so words over
LONG_WORD bytes are hashed one by one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from switchboard.llm.common import text_bytes

U64 = np.uint64
# The base of the polynomial and its inverse modulo 2**64, and the multipliers of a
# well-known 64-bit finaliser.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MIX_1, MIX_2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

LONG_WORD = 64

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
# Bytes that stand between tokens of letters and digits: the rest of ASCII.
NOT_ALPHANUMERIC = np.ones(256, bool)
NOT_ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
NOT_ALPHANUMERIC[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers = {BASE: np.ones(1, U64), BASE_INVERSE: np.ones(1, U64)}


def powers(base: int, n: int) -> np.ndarray:
    known = _powers[base]
    if len(known) < n:
        grown = np.full(max(n, 1 << 16), U64(base % (1 << 64)))
        grown[0] = 1
        _powers[base] = known = np.multiply.accumulate(grown)
    return known[:n]


def mix(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> U64(30))) * MIX_1
    value = (value ^ (value >> U64(27))) * MIX_2
    return value ^ (value >> U64(31))


def running_sum(data: np.ndarray) -> np.ndarray:
    """Polynomial sums of all prefixes; ``span_hash`` reads any span from them."""
    terms = data.astype(U64)
    terms += U64(1)
    terms *= powers(BASE, len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(terms, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    raw = (sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(sums))[starts]
    return mix(raw + (ends - starts).astype(U64) * MIX_2)


@dataclass
class Words:
    """Words of a batch in order: hash, place in ``data``, and the row they are in.

    The text of row ``r`` is ``data`` from ``offsets[r]`` to ``offsets[r + 1]``.

    The words of row ``r`` are those from ``bounds[r]`` to ``bounds[r + 1]``.
    """

    data: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    bounds: np.ndarray

    @property
    def n_rows(self) -> int:
        return len(self.bounds) - 1


def split_words(texts: pa.Array, between: np.ndarray = BLANK) -> Words:
    """``between`` tells for each byte whether it separates words."""
    raw, offsets = text_bytes(texts)
    data = LOWER[raw]
    inside = ~between[data]
    at_edge = np.zeros(len(data) + 1, bool)
    at_edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~at_edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~at_edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(starts, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    hashes = span_hash(running_sum(data), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest()
        hashes[i] = int.from_bytes(digest, "little")
    return Words(data, offsets, hashes, starts, ends, rows, bounds)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``n`` words of a row; of all its words where it has fewer."""
    hashes, rows = words.hashes, words.rows
    if not len(hashes):
        return hashes, rows
    last = max(len(hashes) - n + 1, 0)
    joined = hashes[:last].copy()
    for i in range(1, n):
        joined = mix(joined * MIX_1 + hashes[i : last + i])
    whole = rows[:last] == rows[n - 1 :] if last else np.zeros(0, bool)
    lengths = np.diff(words.bounds)
    short = np.flatnonzero((lengths > 0) & (lengths < n))
    extra = hashes[words.bounds[short]].copy()
    for i in range(1, n - 1):
        longer = lengths[short] > i
        at = words.bounds[short[longer]] + i
        extra[longer] = mix(extra[longer] * MIX_1 + hashes[at])
    found = np.concatenate([joined[whole], mix(extra + MIX_2)])
    return found, np.concatenate([rows[:last][whole], short])


def distinct_per_row(hashes: np.ndarray, rows: np.ndarray, n_rows: int):
    """Distinct (hash, row), sorted by row and hash, and where each row begins among them."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[new], rows[new]
    return hashes, rows, np.searchsorted(rows, np.arange(n_rows + 1))

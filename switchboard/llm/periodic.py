"""All maximal periodic runs of the words of a text.

Every run of period p with at least 2 p words holds two places i and i + p with i a multiple of p,
so the pairs (i, i + p) of all grids are enough: n / p of them for each p. How far the words agree
after and before such a pair gives the run's ends.

The longest common extension of two places comes from suffixes at the places of a difference
cover only: of any two places, some equal distance below the cover's period leads to two covered
ones. Those few words are compared, then the sorted suffixes are asked: a sparse table over the
common prefixes of neighbours answers the least between two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchboard.llm.common import id_and_text, slices, text_bytes
from switchboard.llm.words import BLANK

SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
# Every difference modulo 7 is one of two of these places.
PERIOD, COVER = 7, np.array([0, 1, 3])
# Grid pairs that are looked at together.
PAIRS_AT_ONCE = 1 << 20


def find_runs(docs: DataFrame, min_length: int = 12, plant: Column | None = None) -> DataFrame:
    """(doc_id, runs, collapsed) of every document.

    A run is a stretch of words with smallest period q (words q apart are equal), at least
    ``min_length`` and 2 q words long, that cannot be extended on either side; runs are ordered
    by start, then period. ``collapsed`` are the words, joined by one space, without those that
    lie behind the first q words of a run.

    ``plant`` is an unsigned number per document from which ``planted`` repeats a part of its
    words first; where it is null the words stay. The operator finds repeats that are known then.

    A null text is empty: no runs and an empty ``collapsed``. A null id is carried and repeated
    rows are answered each for itself. Other columns are ignored, and an empty table gives no rows.
    """
    planted_by = F.lit(None).cast("long") if plant is None else plant
    rows = docs.select("doc_id", "text", planted_by.cast("long").alias("plant"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _answer(part, min_length)

    return id_and_text(rows, "plant").mapInArrow(run, SCHEMA)


def _answer(batch: pa.RecordBatch, min_length: int) -> pa.RecordBatch:
    words, bounds = split(batch.column("text"))
    order = np.arange(len(words))
    for row, number in enumerate(batch.column("plant").to_pylist()):
        if number is not None and number % 10 == 0:
            first, last = bounds[row : row + 2]
            order[first:last] = first + planted(last - first, number)
    words = words.take(pa.array(order))
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows, starts, lengths, periods = runs_of(codes, bounds, min_length)

    # How many runs hold a word behind their first period.
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, bounds[rows] + starts + periods, 1)
    np.add.at(inside, bounds[rows] + starts + lengths, -1)
    keep = inside.cumsum()[:-1] == 0
    kept_bounds = np.concatenate([[0], keep.cumsum()])[bounds]
    kept = pa.ListArray.from_arrays(pa.array(kept_bounds, pa.int32()), words.filter(pa.array(keep)))
    fields = pa.StructArray.from_arrays(
        [pa.array(c) for c in (starts, lengths, periods)], ["start", "length", "period"]
    )
    ends = np.searchsorted(rows, np.arange(batch.num_rows + 1))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields),
            pc.binary_join(kept, pa.scalar(b" ", pa.large_binary())).cast(pa.binary()).view(pa.string()),
        ],
        ["doc_id", "runs", "collapsed"],
    )


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and where those of each text begin among them."""
    data, offsets = text_bytes(texts)
    inside = ~BLANK[data]
    at_edge = np.zeros(len(data) + 1, bool)
    at_edge[offsets] = True
    starts = np.flatnonzero(inside & ~(np.concatenate([[False], inside[:-1]]) & ~at_edge[:-1]))
    ends = np.flatnonzero(inside & ~(np.concatenate([inside[1:], [False]]) & ~at_edge[1:])) + 1
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    buffers = [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[inside]))]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers)
    return words, np.searchsorted(starts, offsets)


def planted(n: int, number: int) -> np.ndarray:
    """Which word stands at each of ``n`` places; one number in ten repeats a part of them up to
    the end."""
    places = np.arange(n)
    if number % 10 or not n:
        return places
    draw = number // 10
    at = draw % n
    period = 1 + (n - at) // (3 + draw % 8)
    places[at:] = at + (places[at:] - at) % period
    return places


def runs_of(
    codes: np.ndarray, bounds: np.ndarray, min_length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, smallest period) of all runs, by row, start and period; the words of
    row ``r`` are ``codes`` from ``bounds[r]`` to ``bounds[r + 1]``."""
    joined, begins = _separated(codes, bounds)
    sizes = np.diff(bounds)

    def pairs() -> Iterator[tuple[np.ndarray, ...]]:
        return _agreeing_pairs(joined, begins, sizes, min_length)

    asked, held, n_pairs = [np.zeros(0, np.int64)], [], 0
    for part in pairs():
        asked.append(np.unique(part[0]))
        n_pairs += len(part[0])
        if n_pairs <= PAIRS_AT_ONCE:
            held.append(part)
    # Only rows that have a pair are sorted.
    asked = np.unique(np.concatenate(asked))
    if not len(asked):
        return (asked,) * 4
    chosen, new_begins = _separated(
        np.concatenate([codes[bounds[r] : bounds[r + 1]] for r in asked]),
        np.concatenate([[0], np.cumsum(sizes[asked])]),
    )
    forward, backward = Extensions(chosen), Extensions(chosen[::-1])
    found = []
    for rows, places, periods in held if n_pairs <= PAIRS_AT_ONCE else pairs():
        begin = new_begins[np.searchsorted(asked, rows)]
        places = places - begins[rows] + begin
        after = forward.longest(places, places + periods)
        last = len(chosen) - places
        before = backward.longest(last, last - periods)
        lengths = before + periods + after
        # Of the grid places in a run the first one stands for it.
        keep = (before < periods) & (lengths >= np.maximum(min_length, 2 * periods))
        found.append([x[keep] for x in (rows, places - before - begin, lengths, periods)])
    rows, starts, lengths, periods = (np.concatenate(column) for column in zip(*found))
    # Periods of one stretch are multiples of the smallest.
    order = np.lexsort((periods, lengths, starts, rows))
    rows, starts, lengths, periods = (x[order] for x in (rows, starts, lengths, periods))
    new = np.ones(len(rows), bool)
    new[1:] = (np.diff(rows) != 0) | (np.diff(starts) != 0) | (np.diff(lengths) != 0)
    order = np.flatnonzero(new)
    order = order[np.lexsort((periods[order], starts[order], rows[order]))]
    return rows[order], starts[order], lengths[order], periods[order]


def _separated(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows in one array, a code of its own after each, and where each row begins in it."""
    n_rows = len(bounds) - 1
    joined = np.empty(len(codes) + n_rows, np.int64)
    row_of = np.repeat(np.arange(n_rows), np.diff(bounds))
    joined[np.arange(len(codes)) + row_of] = codes
    top = int(codes.max()) + 1 if len(codes) else 0
    joined[bounds[1:] + np.arange(n_rows)] = top + np.arange(n_rows)
    return joined, bounds[:-1] + np.arange(n_rows)


def _agreeing_pairs(joined, begins, sizes, min_length):
    """(row, place in ``joined``, period) of the grid pairs that may lie in a run.

    A run agrees with itself moved by its period on at least min_length / 2 words, around the
    pair: so many are compared on both sides, and pairs that agree on fewer are left out.
    """
    least = -(-min_length // 2)
    guard = np.arange(-1, -1 - least - 1, -1)
    padded = np.concatenate([guard, joined, guard - len(guard)])
    for rows, places, periods in _grid(begins, sizes, min_length):
        same = joined[places] == joined[places + periods]
        rows, places, periods = rows[same], places[same], periods[same]
        agree = np.ones(len(places), np.int64)
        for step in (1, -1):
            going = np.ones(len(places), bool)
            for distance in range(1, least):
                here = places + (len(guard) + step * distance)
                going &= padded[here] == padded[here + periods]
                agree += going
        enough = agree >= least
        yield rows[enough], places[enough], periods[enough]


def _grid(begins, sizes, min_length):
    """(row, place, period) of all pairs (i, i + p), i a multiple of p, in bounded parts."""
    rows = np.flatnonzero(sizes >= min_length)
    row_of = np.repeat(rows, sizes[rows] // 2)
    first = np.concatenate([[0], np.cumsum(sizes[rows] // 2)])
    periods = np.arange(len(row_of)) - np.repeat(first[:-1], sizes[rows] // 2) + 1
    counts = (sizes[row_of] - 1) // periods
    totals = np.concatenate([[0], np.cumsum(counts)])
    start = 0
    while start < len(row_of):
        stop = int(np.searchsorted(totals, totals[start] + PAIRS_AT_ONCE, "right")) - 1
        stop = max(stop, start + 1)
        part = slice(start, stop)
        which = np.repeat(np.arange(start, stop), counts[part])
        number = np.arange(totals[start], totals[stop]) - totals[which]
        yield row_of[which], begins[row_of[which]] + number * periods[which], periods[which]
        start = stop


class Extensions:
    """Longest common extensions of two places of an array, from covered suffixes alone."""

    def __init__(self, codes: np.ndarray):
        # Behind the end stand codes that are found nowhere else.
        n = len(codes)
        length = (n // PERIOD + 3) * PERIOD
        self.codes = np.concatenate([codes, -1 - np.arange(length - n)])
        # From two places, the first distance that leads to covered ones.
        covered = np.isin(np.arange(PERIOD), COVER)
        both = covered[np.add.outer(np.arange(PERIOD), np.arange(PERIOD)) % PERIOD]
        self.distance = np.array([[np.argmax(x & y) for y in both] for x in both])
        self.number_of = np.full(PERIOD, -1)
        self.number_of[COVER] = np.arange(len(COVER))
        # The last blocks would reach over the end.
        blocks = np.arange(length // PERIOD - 1) * PERIOD
        self.places = (blocks[:, None] + COVER).ravel()
        self._sort()
        self._common_prefixes()

    def _sort(self) -> None:
        """Ranks by growing prefixes: of suffixes that agree on h words, the one whose suffix h
        words on comes first does; suffixes that are alone with their prefix are done."""
        n = len(self.places)
        order = np.lexsort(_packed(self.codes, self.places)[::-1])
        words = self.codes[self.places[order][:, None] + np.arange(PERIOD)]
        new = np.ones(n, bool)
        new[1:] = (words[1:] != words[:-1]).any(axis=1)
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.levels = [rank]
        step = len(COVER)
        while True:
            alone = np.bincount(rank, minlength=n)[rank] == 1
            open_ = np.flatnonzero(~alone)
            if not len(open_):
                break
            # No two suffixes agree up to the end, so an open one has a suffix behind it.
            key = rank[open_].astype(np.int64) * n + rank[open_ + step]
            order = np.argsort(key, kind="stable")
            key, group = key[order], rank[open_[order]]
            at = np.arange(len(key))
            first = np.maximum.accumulate(np.where(np.diff(group, prepend=-1) != 0, at, 0))
            own = np.maximum.accumulate(np.where(np.diff(key, prepend=-1) != 0, at, 0))
            rank = rank.copy()
            rank[open_[order]] = group + (own - first)
            self.levels.append(rank)
            step *= 2
        self.rank = rank

    def _common_prefixes(self) -> None:
        """The sparse table of the common prefixes of suffixes that are neighbours in order."""
        by_rank = np.argsort(self.rank)
        one, two = by_rank[:-1].copy(), by_rank[1:].copy()
        common = np.zeros(len(one), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            # Equal ranks of a level agree on so many blocks.
            same = self.levels[level][one] == self.levels[level][two]
            common += np.where(same, PERIOD << level, 0)
            step = np.where(same, len(COVER) << level, 0)
            one, two = one + step, two + step
        del self.levels
        common += self._direct(self.places[one], self.places[two], PERIOD)
        table = [common.astype(np.int32)]
        while (width := 1 << len(table)) <= len(common):
            half = table[-1]
            table.append(np.minimum(half[: -(width // 2)], half[width // 2 :]))
        self.table = table

    def _direct(self, one: np.ndarray, two: np.ndarray, most) -> np.ndarray:
        """Words on which two places agree, up to ``most``."""
        agree = np.zeros(len(one), np.int64)
        going = np.ones(len(one), bool)
        for distance in range(PERIOD):
            here = np.flatnonzero(going & (distance < most))
            here = here[self.codes[one[here] + distance] == self.codes[two[here] + distance]]
            if not len(here):
                break
            agree[here] += 1
            going = np.zeros(len(one), bool)
            going[here] = True
        return agree

    def longest(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Words on which the two places agree; the places of a pair differ."""
        distance = self.distance[one % PERIOD, two % PERIOD]
        agree = self._direct(one, two, distance)
        far = np.flatnonzero(agree == distance)
        at = [self._rank_at(place[far] + distance[far]) for place in (one, two)]
        low, high = np.minimum(*at), np.maximum(*at)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        least = np.empty(len(far), np.int64)
        for k in np.unique(level):
            here = level == k
            table = self.table[k]
            least[here] = np.minimum(table[low[here]], table[high[here] - (1 << int(k))])
        agree[far] += least
        return agree

    def _rank_at(self, place: np.ndarray) -> np.ndarray:
        return self.rank[place // PERIOD * len(COVER) + self.number_of[place % PERIOD]]


def _packed(codes: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """The first PERIOD words at each place as numbers, several words in one, in order."""
    low = int(codes.min())
    bits = max(1, int(codes.max() - low).bit_length())
    together = max(1, 63 // bits)
    keys = []
    for begin in range(0, PERIOD, together):
        key = np.zeros(len(places), np.int64)
        for i in range(begin, min(begin + together, PERIOD)):
            key = (key << bits) | (codes[places + i] - low)
        keys.append(key)
    return keys

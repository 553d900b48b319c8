"""Benchmark items in documents, also edited ones: word-pair seeds, then local alignment.

Items are read in blocks of bounded size and each block is sent to all tasks; documents are read
where they are and never shuffled. For a block,

1. two words of an item with at most one other between them are a seed, however frequent: one may
   be frequent only because its item leaked often, whole or edited. A seed falls on two words of a
   document with at most one other between them;
2. where enough seeds of an item fall on one passage of a document, and the passage has enough of
   the item's words for the least score that counts, Smith-Waterman alignment of their words scores
   the copy.

No alignment that counts is left out. Of m matches in a row, two that follow each other are a seed
unless what is between them costs 1 or more: one mismatch or one gap costs 0.5. So an alignment with
the score s has at least m - 1 - (m - s) = s - 1 seeds, on different words of the document, and
at most 2 (m - s) gaps, which bounds how far its seeds and its ends lie apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from switchboard.llm.common import slices
from switchboard.llm.words import NOT_ALPHANUMERIC, Words, mix, split_words

BLOCK_WORDS = 500_000
# Seed occurrences that are held at once; one row may have more.
HITS = 2_000_000
# Words from the first to the second of a seed.
STEPS = (1, 2)
# Fixed scores of the alignment; the best score of an item is its number of words.
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5

LEAK = [("score", T.DoubleType()), ("start", T.LongType()), ("end", T.LongType())]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    min_score: float = 0.5,
    min_words: int = 8,
    long_run: int = 13,
) -> DataFrame:
    """(doc, leaks): all columns of each row as a struct, and the items found in its text.

    ``leaks`` holds each item found at most once: its score as a share of the item's words, and
    the passage of its best alignment in code points, end exclusive. Alignments count that score
    at least ``min_words`` words or, for a shorter item, the whole item. Those of different words
    of an item are added, wherever in the text they are. An item counts as found from a score of
    ``min_score``, or from one alignment of ``long_run`` words, however long the item is.

    A null or empty text has no leaks, and neither does an item without words match anything.
    Items that repeat id and text count once; a null item_id is carried. Rows are searched each
    for itself, also repeated ones. Empty tables and further columns are fine.
    """
    item_id = ("item_id", items.schema["item_id"].dataType)
    leak = T.StructType([T.StructField(*field) for field in (item_id, *LEAK)])
    rows = docs.select(
        F.struct("*").alias("doc"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.array().cast(T.ArrayType(leak)).alias("leaks"),
    )
    limits = Limits(min_score, min_words, long_run)
    for block in _blocks(items, limits):
        rows = _searched(rows, block, limits)
    return rows.select("doc", "leaks")


@dataclass
class Limits:
    """Least share of an item, and least scores of each alignment and of one that is enough."""

    share: float
    words: int
    long_run: int

    def least(self, sizes: np.ndarray) -> np.ndarray:
        """Least score of an alignment that counts, for items of these sizes."""
        return np.minimum(self.words, sizes)


@dataclass
class Block:
    """Items as word hashes, and their seeds in order of hash: item, and place in it."""

    steps: tuple[int, ...]
    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray
    items: np.ndarray
    places: np.ndarray


def _blocks(items: DataFrame, limits: Limits) -> Iterator[Block]:
    rows: list = []
    size = 0
    texts = items.select("item_id", "text").where("text is not null").distinct()
    for row in texts.toLocalIterator():
        rows.append(row)
        size += row.text.count(" ") + 1
        if size >= BLOCK_WORDS:
            yield from _blocks_of(rows, limits)
            rows, size = [], 0
    yield from _blocks_of(rows, limits)


def _blocks_of(rows: list, limits: Limits) -> Iterator[Block]:
    """Items of which one word counts have single words as seeds, in a block of their own."""
    rows = sorted(rows, key=lambda row: (row.item_id is None, row.item_id, row.text))
    words = split_words(pa.array([row.text for row in rows], pa.string()), NOT_ALPHANUMERIC)
    tokens = [words.hashes[a:b] for a, b in zip(words.bounds, words.bounds[1:])]
    least = limits.least(np.array([len(t) for t in tokens], np.int64))
    for steps, chosen in (((0,), least == 1), (STEPS, least > 1)):
        own = [i for i, t in enumerate(tokens) if chosen[i] and len(t)]
        if not own:
            continue
        mine = split_words(pa.array([rows[i].text for i in own]), NOT_ALPHANUMERIC)
        seeds, items, places = _seeds(mine, steps)
        places = places - mine.bounds[items]
        order = np.lexsort((places, items, seeds))
        found = (x[order] for x in (seeds, items, places))
        yield Block(steps, [rows[i].item_id for i in own], [tokens[i] for i in own], *found)


def _seeds(words: Words, steps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, row, place of its first word), by place."""
    seeds, places = [], []
    for step in steps:
        last = max(len(words.hashes) - step, 0)
        first, second = words.hashes[:last], words.hashes[step:]
        inside = words.rows[:last] == words.rows[step:]
        seeds.append((mix(first) + second)[inside] if step else first)
        places.append(np.flatnonzero(inside))
    places = np.concatenate(places)
    order = np.argsort(places, kind="stable")
    return np.concatenate(seeds)[order], words.rows[places[order]], places[order]


def _searched(rows: DataFrame, block: Block, limits: Limits) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = split_words(part.column("text"), NOT_ALPHANUMERIC)
                leaks = part.column("leaks").to_pylist()
                for row, leak in _leaks(words, block, limits):
                    leaks[row].append(leak)
                kind = part.schema.field("leaks").type
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("text"), pa.array(leaks, kind)],
                    names=["doc", "text", "leaks"],
                )

    return rows.mapInArrow(run, rows.schema)


def _leaks(words: Words, block: Block, limits: Limits):
    """(row, leak) for every item found in the passages that have enough of its seeds."""
    sizes = np.array([len(w) for w in block.words])
    passages: dict[tuple[int, int], list] = {}
    gaps = 2 * (sizes - limits.least(sizes))  # of an alignment that counts
    for r, i, first, last in _passages(words, block, limits, sizes, gaps):
        slack = int(gaps[i])
        left = max(first - slack, int(words.bounds[r]))
        right = min(last + int(sizes[i]) + slack, int(words.bounds[r + 1]))
        own = passages.setdefault((r, i), [])
        if own and left <= own[-1][1]:
            own[-1][1] = max(right, own[-1][1])
        else:
            own.append([left, right])
    for (r, i), own in sorted(passages.items()):
        # A gap as long as the item: no alignment gains by going across.
        gap = np.full(int(sizes[i]), -1)
        places = np.concatenate([x for a, b in own for x in (np.arange(a, b), gap)])
        score, first, last = _found(block.words[i], words.hashes[places], places < 0, limits)
        if score:
            span = _code_points(words, r, int(places[first]), int(places[last - 1]) + 1)
            yield r, {"item_id": block.ids[i], "score": score / int(sizes[i]), **span}


def _found(item: np.ndarray, passage: np.ndarray, gap: np.ndarray, limits: Limits):
    """(score, start, end): the sum of the alignments and the place of the best one. The score is
    0 if the item is not found."""
    n = len(item)
    part, whole = min(limits.words, n), max(limits.share * n, min(limits.words, n))
    # Words as their place among those of the item; others are equal to none.
    known, item = np.unique(item, return_inverse=True)
    at = np.minimum(np.searchsorted(known, passage), len(known) - 1)
    passage = np.where((known[at] == passage) & ~gap, at, -1)
    if np.isin(item, passage).sum() < min(whole, max(limits.long_run, part)):
        return 0.0, 0, 0
    total, best, start, end = 0.0, 0.0, 0, 0
    while total < whole and most(item, passage) >= part:
        score, from_item, to_item, first, last = _aligned(item, passage)
        if score < part:
            break
        if score > best:
            best, start, end = score, first, last
        total += score
        item[from_item:to_item], passage[first:last] = -2, -1
    found = total >= whole or best >= max(limits.long_run, part)
    return (total if found else 0.0), start, end


def _passages(words: Words, block: Block, limits: Limits, sizes: np.ndarray, gaps: np.ndarray):
    """(row, item, first begin, last begin) of the passages with enough seeds."""
    least = limits.least(sizes)
    enough = np.maximum(least - 1, 1)
    # Alignments that make a find use different words of the item, and each has at least
    # (least - 1) / least seeds for a point of its score.
    whole = np.maximum(limits.share * sizes, least) * enough / np.maximum(least, 1)
    in_all = np.minimum(whole, np.maximum(np.maximum(limits.long_run, least) - 1, 1))
    for row, item, place in _hits(words, block):
        # A hit says where the item would begin; hits of one copy begin near each other.
        begin = place[:, 0] - place[:, 1]
        order = np.lexsort((begin, item, row))
        row, item, begin = row[order], item[order], begin[order]
        at, of_item = place[order].T
        pair = np.cumsum(_changes(row, item)) - 1
        # The seeds of an alignment begin within its gaps of each other.
        width = int(begin.max() - begin.min() + gaps.max()) + 1
        line = pair * width + (begin - begin.min())
        stop = np.searchsorted(line, line + gaps[item], "right")
        full = np.flatnonzero(stop - np.arange(len(line)) >= enough[item])
        marks = np.bincount(full, minlength=len(line) + 1) - np.bincount(
            stop[full], minlength=len(line) + 1
        )
        keep = np.cumsum(marks[:-1]) > 0
        row, item, begin, at, of_item, pair = (
            x[keep] for x in (row, item, begin, at, of_item, pair)
        )
        new = _changes(row, item)
        new[1:] |= begin[1:] - begin[:-1] > gaps[item[1:]]
        starts = np.append(np.flatnonzero(new), len(row))
        passage = np.cumsum(new) - 1
        low = starts[:-1]
        good = _different(passage, at) >= enough[item[low]]
        good &= _different(passage, of_item) >= enough[item[low]]
        good &= _different(pair, of_item)[pair[low]] >= in_all[item[low]]
        chosen = np.flatnonzero(good)
        low, high = low[chosen], starts[chosen + 1] - 1
        yield from zip(*(x.tolist() for x in (row[low], item[low], begin[low], begin[high])))


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where a row of sorted keys is not like the one before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([key[1:] != key[:-1] for key in keys], axis=0)
    return new


def _different(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Different values per group number."""
    order = np.lexsort((value, group))
    return np.bincount(group[order][_changes(group[order], value[order])])


def most(item: np.ndarray, passage: np.ndarray) -> int:
    """No alignment scores more: words of the item in the passage, and of a stretch of the passage
    in the item. An alignment above 0 has fewer gaps than two to a match, so it is no longer than
    three times the item."""
    inside = np.concatenate([[0], np.cumsum(np.isin(passage, item))])
    width = min(3 * len(item), len(passage))
    stretch = int((inside[width:] - inside[: len(inside) - width]).max())
    return min(stretch, int(np.isin(item, passage).sum()))


def _hits(words: Words, block: Block):
    """(row, item, (place in batch, place in item)) of every seed occurrence, in parts of about
    ``HITS`` occurrences and whole rows."""
    seeds, rows, place = _seeds(words, block.steps)
    low = np.searchsorted(block.seeds, seeds, "left")
    n = np.searchsorted(block.seeds, seeds, "right") - low
    hit = np.flatnonzero(n)
    ends = np.cumsum(n[hit])
    start = 0
    while start < len(hit):
        held = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, held + HITS, "right")))
        if stop < len(hit):  # back to the begin of a row, or on to its end if it has too many
            own = int(np.searchsorted(rows[hit], rows[hit[stop]], "left"))
            stop = own if own > start else int(np.searchsorted(rows[hit], rows[hit[stop]], "right"))
        part, start = hit[start:stop], stop
        times = n[part]
        before = np.repeat(np.cumsum(times) - times, times)
        entry = np.repeat(low[part], times) + np.arange(times.sum()) - before
        at = np.stack([np.repeat(place[part], times), block.places[entry]], 1)
        yield np.repeat(rows[part], times), block.items[entry], at


def _code_points(words: Words, row: int, first: int, last: int) -> dict:
    begin = words.offsets[row]
    text = (words.data[begin : words.ends[last - 1]] & 0xC0) != 0x80
    start = int(text[: words.starts[first] - begin].sum())
    return {"start": start, "end": int(text.sum())}


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: its score, and where it begins and ends in the passage."""
    score, _, _, start, end = _aligned(item, passage)
    return score, start, end


def _aligned(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int, int, int]:
    """Best local alignment: its score, and where it begins and ends in the item and passage."""
    score, to_item, end = _best(item, passage)
    if not end:
        return 0.0, 0, 0, 0, 0
    _, back_item, back = _best(item[:to_item][::-1], passage[:end][::-1])
    return score, to_item - back_item, to_item, end - back, end


def _best(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    places = np.arange(len(passage) + 1)
    before = np.zeros(len(passage) + 1)
    best, to_item, end = 0.0, 0, 0
    for n, word in enumerate(item, 1):
        here = np.zeros_like(before)
        diagonal = before[:-1] + np.where(passage == word, MATCH, MISMATCH)
        np.maximum(np.maximum(diagonal, before[1:] + GAP), 0, out=here[1:])
        # Gaps in the item: the best of all places to the left, less a gap for each step.
        here = np.maximum(here, np.maximum.accumulate(here - GAP * places) + GAP * places)
        top = int(here.argmax())
        if here[top] > best:
            best, to_item, end = float(here[top]), n, top
        before = here
    return best, to_item, end

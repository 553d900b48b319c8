"""Byte strings of a fixed length that occur more than once are cut from all texts.

A suffix array of every byte of a large corpus is many times the corpus. Only suffixes that begin
at anchors are sorted here: of the positions in each window of ``LENGTH`` bytes, the one whose
``LEAD`` bytes have the smallest hash. Equal windows have their anchor at the same place, so every
repeated window is found at an anchor, and there is one anchor in about 85 bytes.

1. Anchored suffixes are range-partitioned by the hash of their leading bytes and of what is
   around them, with sampled splitters, and sorted in each part. Suffixes whose leading bytes
   stand alone are done with. Suffixes whose whole surroundings are repeated are removed whole.
   A run of equal leading bytes that may go on in the next part is never taken as complete.
2. The others, at the edges of repeats, are compared window by window with all suffixes of equal
   leading bytes. Where these are too many for one task, or go on in another part, they are dealt
   by window instead, counted in each task before they are sent.
3. The spans found are merged per text and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchboard.llm.common import (
    ask_small_batches,
    id_and_text,
    slices,
    stored,
    text_bytes,
)
from switchboard.llm.words import MIX_1, U64, mix, running_sum, span_hash

LEAD = 32
# Suffixes of equal leading bytes that one task compares; more are dealt by window.
GROUP = 20_000

FULL, OPEN, MANY, EDGE_OF_PART = 1, 2, 4, 8
SURROUNDINGS, WINDOW, REPEATED_WINDOW, SPAN = range(4)


def cut_repeats(docs: DataFrame, length: int = 200, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) per row: the removed spans [start, end) of bytes, in order,
    and the bytes that stay.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the
    same text or another; overlapping occurrences count. Strings are compared as 64-bit hashes
    within groups of equal 64-bit hashes of their leading bytes. ``group`` is the number of
    suffixes of equal leading bytes that one task compares.

    A null text is empty. Rows equal in doc_id and text are one text, so they do not repeat each
    other; they give equal results. A null doc_id is an id like any other. Other columns are
    ignored, and an empty table gives no rows.
    """
    if length <= LEAD:
        raise ValueError(f"length must be above {LEAD}")
    ask_small_batches(docs.sparkSession)
    texts = id_and_text(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("lead", "around", "row", "at")
    anchored = texts.select("row", "text").mapInArrow(
        lambda batches: _anchored(batches, length), "lead long, around long, row long, at int"
    )
    suffixes = anchored.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    marks = stored(
        suffixes.mapInArrow(
            lambda batches: _marked(batches, group), "row long, at int, lead long, kind int"
        ),
        "repeat-marks",
    )
    full = marks.where(F.col("kind").bitwiseAND(FULL) != 0).select(
        "row",
        (F.col("at") - (length - LEAD)).alias("start"),
        (F.col("at") + length).alias("end"),
    )
    mark = F.struct("at", "lead", "kind")
    unsure = marks.where(F.col("kind").bitwiseAND(OPEN) != 0)
    unsure = unsure.groupBy("row").agg(F.collect_list(mark).alias("marks"))
    # The same exchange of texts serves this join and the last one.
    compared = (
        texts.join(unsure.withColumnRenamed("row", "its_row"), F.col("row") == F.col("its_row"))
        .mapInArrow(lambda batches: _surroundings(batches, length), SENT)
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(lambda batches: _compared(batches, length), "row long, start int, end int")
    )
    spans = full.unionByName(compared).groupBy("row").agg(
        F.collect_list(F.struct("start", "end")).alias("found")
    )
    joined = texts.join(
        spans.withColumnRenamed("row", "its_row"), F.col("row") == F.col("its_row"), "left"
    )
    return joined.select("doc_id", "text", "found").mapInArrow(
        _cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    )


# 1. Anchors


def _anchored(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            data, offsets = text_bytes(part.column("text"))
            sums = running_sum(data)
            at = anchors(sums, offsets, length)
            own = np.searchsorted(offsets, at, "right") - 1
            left = np.maximum(at - (length - LEAD), offsets[own])
            right = np.minimum(at + length, offsets[own + 1])
            around = mix(span_hash(sums, left, right) + (at - left).astype(U64) * MIX_1)
            yield pa.RecordBatch.from_pydict(
                {
                    "lead": pa.array(span_hash(sums, at, at + LEAD).view(np.int64)),
                    "around": pa.array(around.view(np.int64)),
                    "row": pa.array(part.column("row").to_numpy()[own]),
                    "at": pa.array((at - offsets[own]).astype(np.int32)),
                }
            )


def anchors(sums: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Positions that are the leftmost smallest of some window of ``length`` bytes of a text."""
    size = int(offsets[-1])
    if size < length:
        return np.zeros(0, np.int64)
    width = length - LEAD + 1
    starts = np.arange(size - LEAD + 1)
    text_of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    values = (span_hash(sums, starts, starts + LEAD) >> U64(32) << U64(32)) | starts.astype(U64)
    values[text_of[starts] != text_of[starts + LEAD - 1]] = np.iinfo(np.uint64).max
    n_windows = size - length + 1
    blocks = -(-(len(values) + width) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[:n_windows], forward[width - 1 : width - 1 + n_windows])
    inside = text_of[:n_windows] == text_of[length - 1 :]
    chosen = (least[inside] & U64(0xFFFFFFFF)).astype(np.int64)
    return chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])] if len(chosen) else chosen


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str):
    """(batch, is it the first, is it the last) with every run of equal keys in one batch."""
    held, first = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        keys = batch.column(key).to_numpy()
        done = int(np.searchsorted(keys, keys[-1]))
        held = batch.slice(done)
        if done:
            yield batch.slice(0, done), first, False
            first = False
    if held is not None:
        yield held, first, True


def _marked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch, is_first, is_last in _whole_groups(batches, "lead"):
        lead, around, row, at = (
            batch.column(c).to_numpy() for c in ("lead", "around", "row", "at")
        )
        differs = np.ones(len(lead), bool)
        differs[1:] = (around[1:] != around[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1])
        differs[1:] |= lead[1:] != lead[:-1]
        lead, around, row, at = (x[differs] for x in (lead, around, row, at))
        new_group = np.concatenate([[True], lead[1:] != lead[:-1]])
        new_class = new_group | np.concatenate([[True], around[1:] != around[:-1]])
        group, of_class = np.cumsum(new_group) - 1, np.cumsum(new_class) - 1
        group_size, class_size = np.bincount(group), np.bincount(of_class)
        at_edge = np.zeros(len(group_size), bool)
        at_edge[0], at_edge[-1] = is_first, is_last
        full = class_size[of_class] > 1
        compare = np.bincount(group, ~full) > 0
        unsure = ~full | (new_class & (compare | at_edge)[group])
        unsure &= (group_size > 1)[group] | at_edge[group]
        kind = full * FULL + unsure * OPEN + at_edge[group] * EDGE_OF_PART
        kind += (np.bincount(group, unsure) > most)[group] * MANY
        keep = (full & (group_size > 1)[group]) | unsure
        yield pa.RecordBatch.from_pydict(
            {
                "row": pa.array(row[keep]),
                "at": pa.array(at[keep]),
                "lead": pa.array(lead[keep]),
                "kind": pa.array(kind[keep].astype(np.int32)),
            }
        )


# 2. Edges of repeats

SENT = "key long, sort int, row long, at int, left int, around binary"


def _surroundings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Suffixes with the bytes around them, by leading bytes; of large groups, windows."""
    for batch in batches:
        for part in slices(batch):
            data, offsets = text_bytes(part.column("text"))
            marks = part.column("marks")
            own = np.repeat(np.arange(part.num_rows), np.diff(marks.offsets.to_numpy()))
            marks = marks.flatten()
            at, lead, kind = (marks.field(i).to_numpy() for i in range(3))
            place = offsets[own] + at
            left = np.maximum(place - (length - LEAD), offsets[own])
            right = np.minimum(place + length, offsets[own + 1])
            row = part.column("row").to_numpy()[own]
            # A group that crosses parts is marked so in all of them; only windows are bounded.
            few = np.flatnonzero((kind & (MANY | EDGE_OF_PART)) == 0)
            if len(few):
                around = _spans_of(data, left[few], right[few])
                yield _sent(lead[few], SURROUNDINGS, row[few], at[few], (place - left)[few], around)
            many = np.flatnonzero((kind & (MANY | EDGE_OF_PART)) != 0)
            if len(many):
                sums = running_sum(data)
                bounds = (place[many], left[many], right[many])
                yield from _windows(sums, *bounds, row[many], at[many], lead[many], length)


def _spans_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    index = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    parts = (offsets.astype(np.int32), data[index])
    buffers = [None, *(pa.py_buffer(part.tobytes()) for part in parts)]
    return pa.Array.from_buffers(pa.binary(), len(starts), buffers)


def _sent(key, sort, row, at, left, around=None) -> pa.RecordBatch:
    n = len(key)
    return pa.RecordBatch.from_pydict(
        {
            "key": pa.array(np.asarray(key, np.int64)),
            "sort": pa.array(np.broadcast_to(np.int32(sort), n)),
            "row": pa.array(np.asarray(row, np.int64)),
            "at": pa.array(np.asarray(at, np.int32)),
            "left": pa.array(np.asarray(left, np.int32)),
            "around": pa.nulls(n, pa.binary()) if around is None else around,
        }
    )


def _windows(sums, place, left, right, row, at, lead, length: int) -> Iterator[pa.RecordBatch]:
    """Each window as a row of its own. Windows found twice here are settled here: their spans
    are passed on, and one row tells the other tasks."""
    for back in range(length - LEAD + 1):
        fits = np.flatnonzero((place - back >= left) & (place - back + length <= right))
        if not len(fits):
            continue
        start = place[fits] - back
        content = span_hash(sums, start, start + length) + lead[fits].view(U64) * MIX_1
        keys = mix(content + U64(back)).view(np.int64)
        _, first, inverse, n = np.unique(
            keys, return_index=True, return_inverse=True, return_counts=True
        )
        twice = n[inverse] > 1
        begins = at[fits] - back
        yield _sent(keys[~twice], WINDOW, row[fits][~twice], begins[~twice], begins[~twice] + length)
        told = first[n > 1]
        yield _sent(keys[told], REPEATED_WINDOW, row[fits][told], begins[told], begins[told])
        spans = mix(row[fits][twice].view(U64)).view(np.int64)
        yield _sent(spans, SPAN, row[fits][twice], begins[twice], begins[twice] + length)


def _compared(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(row, start, end): removed spans."""
    for batch, _, _ in _whole_groups(batches, "key"):
        key, sort, row, at, left = (
            batch.column(c).to_numpy() for c in ("key", "sort", "row", "at", "left")
        )
        _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        done = (sort == SPAN) | ((sort == WINDOW) & (n[inverse] > 1))
        yield _span_batch(row[done], at[done], left[done])
        whole = np.flatnonzero((sort == SURROUNDINGS) & (n[inverse] > 1))
        if not len(whole):
            continue
        data, offsets = text_bytes(batch.column("around").take(pa.array(whole)))
        sums = running_sum(data)
        place = offsets[:-1] + left[whole]
        for back in range(length - LEAD + 1):
            start = place - back
            fits = np.flatnonzero((start >= offsets[:-1]) & (start + length <= offsets[1:]))
            if not len(fits):
                continue
            content = span_hash(sums, start[fits], start[fits] + length)
            content = mix(content + key[whole[fits]].view(U64) * MIX_1)
            _, inverse, n = np.unique(content, return_inverse=True, return_counts=True)
            hit = whole[fits[n[inverse] > 1]]
            yield _span_batch(row[hit], at[hit] - back, at[hit] - back + length)


def _span_batch(row, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "row": pa.array(np.asarray(row, np.int64)),
            "start": pa.array(np.asarray(start, np.int32)),
            "end": pa.array(np.asarray(end, np.int32)),
        }
    )


# 3. Cutting


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, spans, kept = [], [], []
        for text, found in zip(batch.column("text"), batch.column("found")):
            data = text.as_buffer().to_pybytes()
            runs = merged(found.values, len(data)) if found.is_valid else []
            ends = [0, *(end for _, end in runs)]
            starts = [*(start for start, _ in runs), len(data)]
            sizes.append(len(data))
            spans.append([{"start": a, "end": b} for a, b in runs])
            kept.append(b"".join(data[a:b] for a, b in zip(ends, starts)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array(sizes, pa.int64()),
                "spans": pa.array(spans, kind),
                "kept": pa.array(kept, pa.binary()),
            }
        )


def merged(found: pa.StructArray, size: int) -> list[tuple[int, int]]:
    """The spans within the text, joined where they overlap or touch."""
    start = np.maximum(found.field(0).to_numpy(), 0)
    end = np.minimum(found.field(1).to_numpy(), size)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return list(zip(start[new].tolist(), end[last].tolist()))

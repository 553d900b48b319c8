"""Near duplicates: an LSH forest proposes, full shingle sets decide.

1. Every text gives the set of its word shingles, and a signature of minimum hashes. Texts with
   equal sets are one node from here on, so exact copies never meet each other again.
2. The forest: each tree orders the nodes by another stretch of the signature. All trees are one
   table, sorted by (tree, label) with sampled splitters. In the sorted order the nodes with the
   longest common prefix stand together; a region is a run with the first ``DEPTH`` values equal,
   and in regions of more than ``NEIGHBOURS`` nodes only deeper prefixes are neighbours.
   Neighbours whose signatures agree enough join one candidate group.
   Neighbours on two sides of a partition boundary are compared in a second pass.
3. Within a candidate group every pair is compared on full sets, in blocks of bounded size; a
   block sends back a spanning forest of its links, never all pairs.
4. Components of the confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchboard.llm.common import id_and_text, slices, stored, text_id
from switchboard.llm.components import connected_components
from switchboard.llm.words import U64, distinct_per_row, mix, shingles, split_words

HASHES = 128
TREES = 32
DEPTH, FULL_DEPTH = 4, 8
NEIGHBOURS = 64
# Neighbours are candidates if their similarity, estimated from all hashes, is at most MARGIN
# percent below the asked one. Two sets at a similarity of 0.8 fail that, in all trees at once, with
# the chance P(Binomial(128, 0.8125) < 80) = 2.0e-7, 1 in 5 million; and they share a region in no
# tree with the chance (1 - 0.8 ** 4) ** 32 = 4.7e-8, 1 in 21 million. Together 1 in 4 million.
MARGIN = 20
BLOCK = 256
# Columns of the membership matrix that are multiplied at once.
SLAB = 4_096

_rng = np.random.default_rng(20)
FACTORS = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
EQUAL_NIBBLES = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], np.uint8)


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_id, n_shingles, component_id, kept) per row.

    Two texts are linked if 100 * common shingles >= percent * all their shingles. A text with
    fewer than ``n_words`` words has the whole of it as its one shingle; a null or empty text, or
    one of blanks, has none and is linked with nothing. ``component_id`` is the smallest doc_id
    reachable over links, ``kept`` tells whether the row has it. Equal rows share a component; a
    null doc_id is never the smallest unless all are null, and then every such row is kept. Other
    columns are ignored, and an empty table gives no rows.
    """
    rows = id_and_text(docs.withColumn("text_id", text_id()), "text_id")
    signed = stored(rows.mapInArrow(lambda b: _signed(b, n_words), SIGNED), "signatures")
    nodes = stored(
        signed.where("n_shingles > 0")
        .groupBy("node")
        .agg(
            F.min(F.struct("doc_id", "text_id")).alias("row"),
            F.min("doc_id").alias("first_id"),
            F.any_value("signature").alias("signature"),
        ),
        "nodes",
    )
    groups = connected_components(_candidates(nodes, percent))
    links = stored(_confirmed(rows, nodes, groups, n_words, percent), "confirmed")
    roots = connected_components(links)
    named = nodes.select("node", "first_id").join(roots, "node")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = roots.join(smallest, "root").select("node", "component_id")
    component = F.coalesce("component_id", "first_id").alias("component_id")
    of_node = stored(
        nodes.select("node", "first_id").join(linked, "node", "left").select("node", component),
        "components",
    )
    found = signed.drop("signature").join(of_node, "node", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select(
        "doc_id",
        "text_id",
        "n_shingles",
        own.alias("component_id"),
        F.col("doc_id").eqNullSafe(own).alias("kept"),
    )


# 1. Sets and signatures

SIGNED = "doc_id long, text_id long, n_shingles long, node binary, signature binary"


def _fixed_binary(values: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    width = values.shape[1] * values.itemsize
    offsets = np.arange(len(values) + 1, dtype=np.int32) * width
    data = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    buffers = [None, pa.py_buffer(offsets.tobytes()), data]
    return pa.Array.from_buffers(pa.binary(), len(values), buffers)


def _sets(batch: pa.RecordBatch, n_words: int):
    words = split_words(batch.column("text"))
    return distinct_per_row(*shingles(words, n_words), words.n_rows)


def _signed(batches: Iterator[pa.RecordBatch], n_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            hashes, _, bounds = _sets(part, n_words)
            full = np.flatnonzero(np.diff(bounds))
            first = bounds[:-1][full]
            signature = np.zeros((part.num_rows, HASHES), np.uint16)
            node = np.zeros((part.num_rows, 2), U64)
            if len(full):
                node[full, 0] = np.add.reduceat(mix(hashes), first)
                node[full, 1] = np.add.reduceat(mix(hashes ^ U64(0x5851F42D4C957F2D)), first)
                upper = (hashes >> U64(32)).astype(np.uint32)
                for i in range(HASHES):
                    least = np.minimum.reduceat((upper ^ SHIFTS[i]) * FACTORS[i], first)
                    signature[full, i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "text_id": part.column("text_id"),
                    "n_shingles": pa.array(np.diff(bounds), pa.int64()),
                    "node": _fixed_binary(node),
                    "signature": _fixed_binary(signature),
                }
            )


# 2. The forest


def _least_equal(percent: int) -> int:
    """Equal nibbles of candidates: hashes that differ have equal ones once in 16 times."""
    similar = max(percent - MARGIN, 0)
    return HASHES * (16 * similar + 100 - similar) // 1600


def _candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that hold the candidate groups together."""
    least = _least_equal(percent)

    def plant(batches):
        for batch in batches:
            yield from _labels(batch)

    trees = nodes.select("node", "signature").mapInArrow(plant, TREE)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("label", "node")
    ordered = trees.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    scanned = ordered.mapInArrow(lambda batches: _scanned(batches, least, True), f"{LINK}, {TREE}")
    scanned = stored(scanned, "neighbours")
    # Neighbours on two sides of a boundary, whatever the number of rows between boundaries: at
    # most 2 * NEIGHBOURS rows of each partition, which do not grow with the input.
    edges = scanned.where("label is not null").select("label", "node", "sketch")
    edges = edges.repartition(1).sortWithinPartitions(*order)
    across = edges.mapInArrow(lambda batches: _scanned(batches, least, False), LINK)
    links = scanned.where("a is not null").select("a", "b").unionByName(across)
    # A node has a link from each tree, mostly to the same few; they are thinned before any join.
    return links.repartition("a").sortWithinPartitions("a").mapInArrow(_thinned, LINK)


TREE, LINK = "label binary, node binary, sketch binary", "a binary, b binary"


def _scanned(batches: Iterator[pa.RecordBatch], least: int, with_edges: bool):
    """Links of rows in order, and with ``with_edges`` the first and last NEIGHBOURS rows."""
    held, n_first, n = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        known = 0 if held is None else held.num_rows
        table = pa.Table.from_batches([batch] if held is None else [held, batch])
        joined = table.combine_chunks().to_batches()[0]
        links = _neighbours(joined, known, least)
        yield _padded(links) if with_edges else links
        if with_edges and n_first < NEIGHBOURS:
            first = batch.slice(0, NEIGHBOURS - n_first)
            n_first += first.num_rows
            yield _padded(first)
        n += batch.num_rows
        held = joined.slice(max(0, joined.num_rows - NEIGHBOURS))
    if with_edges and held is not None:
        yield _padded(held.slice(max(0, n_first - (n - held.num_rows))))  # no row twice


def _padded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """With all columns of links and trees; those that the batch has not are null."""
    has, none = set(batch.schema.names), pa.nulls(batch.num_rows, pa.binary())
    names = ("a", "b", "label", "node", "sketch")
    return pa.RecordBatch.from_pydict({c: batch.column(c) if c in has else none for c in names})


def _matrix(column: pa.Array, dtype=np.uint8) -> np.ndarray:
    joined = b"".join(value.as_buffer() for value in column)
    return np.frombuffer(joined, dtype).reshape(len(column), -1)


def _labels(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    signature = _matrix(batch.column("signature"), np.uint16)
    nibbles = (signature & np.uint16(15)).astype(np.uint8)
    sketch = _fixed_binary(nibbles[:, 0::2] << 4 | nibbles[:, 1::2])  # of all hashes
    for tree in range(TREES):
        at = (np.arange(FULL_DEPTH) + tree * DEPTH) % HASHES
        values = np.ascontiguousarray(signature[:, at], ">u2").view(np.uint8)
        label = np.hstack([np.full((len(values), 1), tree, np.uint8), values])
        yield pa.RecordBatch.from_pydict(
            {"label": _fixed_binary(label), "node": batch.column("node"), "sketch": sketch}
        )


def _neighbours(batch: pa.RecordBatch, known: int, least: int) -> pa.RecordBatch:
    """Links from each row after ``known`` to the rows before it in its region that are alike."""
    label = _matrix(batch.column("label"))
    sketch = _matrix(batch.column("sketch"))
    region = np.zeros((len(label), 8), np.uint8)
    region[:, : 2 * DEPTH] = label[:, 1 : 1 + 2 * DEPTH]
    region = region.view(U64).ravel()
    joined = Links(len(label))
    for step in range(1, min(NEIGHBOURS, len(label) - 1) + 1):
        same_tree = label[step:, 0] == label[:-step, 0]
        rows = np.flatnonzero((region[step:] == region[:-step]) & same_tree)
        if not len(rows):
            break
        rows = rows[rows + step >= known]
        alike = EQUAL_NIBBLES[sketch[rows + step] ^ sketch[rows]].sum(1) >= least
        joined.add(rows[alike] + step, rows[alike])
    return _stars(batch.column("node"), joined)


def _stars(names: pa.Array, joined: Links) -> pa.RecordBatch:
    """The groups as links to their smallest node, which are often the same in other trees."""
    used = sorted({x for pair in joined.kept for x in pair})
    roots = [joined.root(x) for x in used]
    names = names.take(pa.array(used, pa.int64())).to_pylist()
    least_of: dict[int, bytes] = {}
    for root, name in zip(roots, names):
        least_of[root] = min(name, least_of.get(root, name))
    links = [(x, least_of[root]) for root, x in zip(roots, names) if x != least_of[root]]
    a, b = (pa.array([pair[i] for pair in links], pa.binary()) for i in range(2))
    return pa.RecordBatch.from_pydict({"a": a, "b": b})


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer links that join the same nodes: a spanning forest of each batch."""
    for batch in batches:
        ends = pa.concat_arrays([batch.column("a"), batch.column("b")]).dictionary_encode()
        at = ends.indices.to_numpy()
        joined = Links(len(ends.dictionary))
        joined.add(at[: batch.num_rows], at[batch.num_rows :])
        yield _stars(ends.dictionary, joined)


class Links:
    """Keeps only links that join two groups of rows that were apart."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.kept: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            one, other = self.root(x), self.root(y)
            if one != other:
                self.parent[one] = other
                self.kept.append((x, y))

    def used(self) -> tuple[list[int], list[int]]:
        return [x for x, _ in self.kept], [y for _, y in self.kept]


# 3. Confirmation on full sets


def _confirmed(
    rows: DataFrame, nodes: DataFrame, groups: DataFrame, n_words: int, percent: int
) -> DataFrame:
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = groups.join(sizes, "root").join(nodes.select("node", "row"), "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = members.select(
        F.col("row.doc_id").alias("id"),
        F.col("row.text_id").alias("its_text"),
        "node",
        "root",
        "blocks",
        block.alias("block"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_id") == F.col("its_text"))
    # Equal rows would repeat a set; one of them is enough, and the blocks drop the others.
    texts = rows.join(members, same).select("node", "root", "blocks", "block", "text")

    def read(batches):
        for batch in batches:
            for part in slices(batch):
                hashes, _, bounds = _sets(part, n_words)
                offsets = pa.py_buffer((bounds * 8).astype(np.int32).tobytes())
                data = pa.py_buffer(hashes.tobytes())
                sets = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, offsets, data])
                columns = {c: part.column(c) for c in ("node", "root", "blocks", "block")}
                yield pa.RecordBatch.from_pydict({**columns, "set": sets})

    sets = texts.mapInArrow(read, "node binary, root binary, blocks int, block int, set binary")
    # A block meets itself and every other block of its group once.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = stored(sets, "sets").select("node", "root", "block", "set", other)
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    dealt = paired.select("node", "root", "set", low, high)
    return dealt.groupBy("root", "low", "high").applyInArrow(
        lambda table: _linked(table, percent), "a binary, b binary"
    )


def _linked(table: pa.Table, percent: int) -> pa.Table:
    batch = table.combine_chunks().to_batches()[0]
    names = _matrix(batch.column("node"), "V16").ravel()
    _, first = np.unique(names, return_index=True)
    batch = batch.take(pa.array(np.sort(first)))
    sets = [np.frombuffer(value.as_buffer(), U64) for value in batch.column("set")]
    sizes = np.array([len(s) for s in sets], np.int64)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(at, minlength=len(values)) > 1
    column = (np.cumsum(shared) - 1)[at]
    use = shared[at]
    column, owner = column[use], owner[use]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(sets), len(sets)))
    for start in range(0, int(shared.sum()), SLAB):
        low, high = np.searchsorted(column, [start, start + SLAB])
        held = np.zeros((len(sets), SLAB), np.float32)
        held[owner[low:high], column[low:high] - start] = 1
        common += held @ held.T
    common = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    a, b = np.nonzero(np.triu(100 * common >= percent * union, 1))
    links = Links(len(sets))
    links.add(a, b)
    a, b = links.used()
    node = batch.column("node")
    ends = {"a": node.take(pa.array(a, pa.int64())), "b": node.take(pa.array(b, pa.int64()))}
    return pa.table(ends)

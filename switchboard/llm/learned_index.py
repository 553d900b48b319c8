"""Approximate nearest neighbours by inner product, with learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts. A small classifier learns to
tell the part of any row, another one in which parts the neighbours of a query lie; ``graph_parts``
has both. Every row is kept in one part, every query asks its most probable parts, as many as a
held-out half of the sample needed for the wanted recall, and all rows of those are compared.

Rows and queries meet in cells. The rows are laid out in tiles of bounded size, neighbouring parts
or a block of a large one; a query goes to every tile with a part it asks, and gives one merged
answer there. A tile that very many queries ask is repeated for blocks of them, so cells are bounded
however large a part or however popular it is. Equal vectors are one entry with its smallest ids, so
copies neither fill a part nor are compared again and again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from switchboard.llm.common import stored
from switchboard.llm.graph_parts import Parts, fit

SAMPLE_ROWS = 16_384
# Rows of a part that are aimed at, and the largest number of parts that the sample can tell.
PART_ROWS, MAX_PARTS = 1_000, 256
# Values of the sample, of the rows of a tile and of the queries of a cell, at most; scores that are
# held at once.
SAMPLE_VALUES = 1 << 24
TILE_VALUES, QUERY_VALUES = 1 << 20, 1 << 17
SCORES_AT_ONCE = 1 << 21

RESULT = "query_id long, rank int, vec_id long, score double"


def nearest_vectors(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    recall: float = 0.95,
    sample_rows: int = SAMPLE_ROWS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows found with the largest inner product with
    each query, largest first, ties to the smaller id; all other rows, where there are fewer.

    ``vectors`` has vec_id and embedding. Scores are sums of products in double precision, in the
    order of the components; a vector that is shorter than others has zeros at its end. A query
    never finds itself. ``recall`` is the share of the true neighbours that is aimed at; the
    parts are learned from the ``sample_rows`` rows with the smallest hashes, and there are about
    one for every ``part_rows`` different vectors.

    Vectors that are null, zero or hold a null or a component that is not finite take no part,
    nor do rows without id. Of rows that repeat an id, the smallest vector counts. Other columns
    are ignored, and an empty table gives no rows.
    """
    # Queries are told from the rows as given, before columns are chosen.
    rows = vectors.withColumn("__query", F.coalesce(is_query, F.lit(False)))
    rows = rows.select("vec_id", "embedding", F.col("__query").alias("is_query"))
    usable = (
        F.col("vec_id").isNotNull()
        & F.exists("embedding", lambda x: x != 0)
        & F.forall("embedding", lambda x: F.abs(x) < float("inf"))
    )
    rows = rows.where(usable)
    by_id = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    smallest = Window.partitionBy("embedding").orderBy("vec_id")
    ranked = by_id.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    entries = stored(
        ranked.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")),
        "entries",
    )
    asked = rows.where("is_query").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = stored(asked, "queries")
    queries = asked.groupBy("embedding").agg(F.min("vec_id").alias("key"))

    n, width = entries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    index = learn(entries, n, width or 0, k, recall, sample_rows, part_rows)
    found = _search(entries, queries, index, k)
    same = asked.join(queries, "embedding").select(F.col("vec_id").alias("query_id"), "key")
    others = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    answered = same.join(found, "key").select(
        "query_id", F.posexplode(F.slice(others, 1, k)).alias("rank", "row")
    )
    rank = (F.col("rank") + 1).alias("rank")
    return answered.select("query_id", rank, "row.vec_id", "row.score")


@dataclass
class Index:
    """The parts of the rows, of which there may be only one. Once their ``sizes`` are known, a
    query asks parts with ``least`` rows or more."""

    n_parts: int
    width: int
    parts: Parts | None
    sizes: np.ndarray | None = None
    least: int = 0

    def keep(self, vectors: np.ndarray) -> np.ndarray:
        return self.parts.keep(vectors) if self.parts else np.zeros(len(vectors), np.int64)

    def ask(self, queries: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.ones((len(queries), 1), bool)
        return self.parts.ask(queries, self.sizes, self.least)


@dataclass
class Tiles:
    """Which parts, from ``low`` up to ``high``, are in each tile, in order of the parts; a large
    part has several tiles of its own, with ``blocks`` for how many. ``copies`` are the blocks of
    the queries that ask a tile."""

    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    blocks: np.ndarray
    copies: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, most: int) -> Tiles:
        low, high, first, blocks, open_rows = [], [], [], [], None
        for part, size in enumerate(sizes.tolist()):
            n = max(1, -(-size // most))
            if n > 1 or open_rows is None or open_rows + size > most:
                first.append(len(low))
                low += [part] * n
                high += [part + 1] * n
                open_rows = size if n == 1 else None
            else:
                first.append(len(low) - 1)
                high[-1] = part + 1
                open_rows += size
            blocks.append(n)
        columns = (np.array(c, np.int64) for c in (low, high, first, blocks))
        return cls(*columns, copies=np.ones(len(low), np.int64))

    def of_rows(self, parts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[parts] + (mixed % self.blocks[parts].astype(np.uint64)).astype(np.int64)

    def of_queries(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, tile) of all tiles with a part that is asked."""
        sums = np.zeros((len(asked), asked.shape[1] + 1), np.int64)
        np.cumsum(asked, axis=1, out=sums[:, 1:])
        return np.nonzero(sums[:, self.high] > sums[:, self.low])


def learn(
    entries: DataFrame, n: int, width: int, k: int, recall: float, sample_rows: int, part_rows: int
) -> Index:
    """Parts fitted to a sample; a single part where there are rows for no more."""
    n_parts = 1 << max(0, (n // max(1, part_rows)).bit_length() - 1)
    n_parts = min(n_parts, MAX_PARTS, max(1, sample_rows // 64))
    if n_parts == 1:
        return Index(1, width, None)
    sample_rows = min(sample_rows, SAMPLE_VALUES // width)
    # The smallest hashes are looked for among about twice as many rows as are wanted.
    hashed = entries.select("embedding", F.pmod(F.xxhash64("embedding"), F.lit(1 << 40)).alias("h"))
    hashed = hashed.where(F.col("h") <= int((1 << 40) * min(1.0, 2 * sample_rows / n)))
    chosen = hashed.orderBy("h", "embedding").limit(sample_rows)
    sample = matrix(chosen.select("embedding").toArrow().column(0).combine_chunks(), width)
    return Index(n_parts, width, fit(sample, n_parts, k, recall))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles; zeros follow the end of a shorter one."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(-1, width)
    result = np.zeros((len(sizes), width))
    result[np.arange(width) < sizes[:, None]] = values
    return result


def _search(entries: DataFrame, queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(key, found): up to k + 1 (vec_id, score) of each query, best first, itself included."""
    vectors = entries.schema["embedding"].dataType.simpleString()
    width = index.width

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = index.keep(matrix(batch.column("embedding"), width))
            yield batch.append_column("part", pa.array(part, pa.int32()))

    homes = entries.mapInArrow(kept, f"embedding {vectors}, ids array<bigint>, part int")
    sizes = np.zeros(index.n_parts, np.int64)
    for part, n in homes.groupBy("part").agg(F.count("*")).collect():
        sizes[part] = n
    tiles = Tiles.of(sizes, max(1, TILE_VALUES // max(1, width)))
    index = replace(index, sizes=sizes, least=k + 1)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, tile = tiles.of_queries(index.ask(matrix(batch.column("embedding"), width)))
            found = batch.take(pa.array(row)).append_column("tile", pa.array(tile, pa.int32()))
            yield found.append_column("copies", pa.array(tiles.copies[tile], pa.int32()))

    def routes() -> DataFrame:
        schema = f"embedding {vectors}, key bigint, tile int, copies int"
        return queries.mapInArrow(routed, schema)

    most = max(1, QUERY_VALUES // max(1, width))
    counted = routes().groupBy("tile").agg(F.count("*")).collect()
    for tile, n in counted:
        tiles.copies[tile] = -(-n // most)

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kept(batches):
            part = batch.column("part").to_numpy()
            tile = tiles.of_rows(part, first_of(batch.column("ids")))
            batch = batch.append_column("tile", pa.array(tile, pa.int32()))
            yield batch.append_column("copies", pa.array(tiles.copies[tile], pa.int32()))

    def cell(copy: Column) -> Column:
        return F.struct("tile", copy.cast("int").alias("copy")).alias("cell")

    homes = entries.mapInArrow(
        laid, f"embedding {vectors}, ids array<bigint>, part int, tile int, copies int"
    )
    left = homes.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select(
        cell(F.col("copy")), "part", F.lit(None).cast("bigint").alias("key"), "ids", "embedding"
    )
    # Queries come behind the rows of their cell.
    right = routes().select(
        cell(F.pmod(F.xxhash64("key"), F.col("copies"))),
        F.lit(index.n_parts).alias("part"),
        "key",
        F.array().cast("array<bigint>").alias("ids"),
        "embedding",
    )
    met = left.unionByName(right).repartition("cell").sortWithinPartitions("cell", "part")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Cell(index, k + 1)
        for batch in batches:
            yield from held.take(batch)

    partial = met.mapInArrow(compare, "key bigint, score double, ids array<bigint>")
    order = [F.desc("score"), F.col("first_id")]
    by_query = Window.partitionBy("key").orderBy(*order)
    best = partial.withColumn("first_id", F.get("ids", F.lit(0)))
    best = best.withColumn("n", F.row_number().over(by_query)).where(F.col("n") <= k + 1)
    one = F.explode(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("i"))))
    listed = best.select("key", one.alias("row")).groupBy("key").agg(
        F.slice(F.sort_array(F.collect_list("row")), 1, k + 1).alias("rows")
    )
    found = F.transform("rows", lambda r: F.struct(r["i"].alias("vec_id"), (-r["s"]).alias("score")))
    return listed.select("key", found.alias("found"))


def first_of(lists: pa.Array) -> np.ndarray:
    """The first value of every list; none is empty."""
    return lists.values.to_numpy()[lists.offsets.to_numpy()[:-1]]


class Cell:
    """The rows of one cell by part, and its queries as they come; rows are sorted before queries."""

    def __init__(self, index: Index, k: int):
        self.index, self.k = index, k
        self.cell: tuple | None = None
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.rows: tuple[np.ndarray, np.ndarray, pa.Array] | None = None

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cells = [batch.column("cell").field(i).to_numpy() for i in range(2)]
        parts = batch.column("part").to_numpy()
        asks = parts == self.index.n_parts
        table = np.column_stack([*cells, asks])
        changes = np.flatnonzero((table[1:] != table[:-1]).any(axis=1)) + 1
        ends = [0, *changes.tolist(), len(table)] if len(table) else []
        for start, stop in zip(ends, ends[1:]):
            some = batch.slice(start, stop - start)
            cell = tuple(table[start, :2].tolist())
            if cell != self.cell:
                self.cell, self.held, self.rows = cell, [], None
            vectors = matrix(some.column("embedding"), self.index.width)
            if asks[start]:
                yield from self._answer(vectors, some.column("key"))
            else:
                self.held.append((parts[start:stop], vectors, some.column("ids")))

    def _answer(self, queries: np.ndarray, keys: pa.Array) -> Iterator[pa.RecordBatch]:
        if self.held:
            parts, vectors, ids = zip(*self.held)
            self.rows = np.concatenate(parts), np.concatenate(vectors), pa.concat_arrays(ids)
            self.held = []
        if self.rows is None:
            return
        parts, rows, ids = self.rows
        first_ids = first_of(ids)
        at_once = max(1, SCORES_AT_ONCE // len(rows))
        for start in range(0, len(queries), at_once):
            some = queries[start : start + at_once]
            query, row = candidates(some, rows, self.k, self.index.ask(some), parts)
            score = inner_products(some, rows, query, row)
            order = np.lexsort((first_ids[row], -score, query))
            query, row, score = query[order], row[order], score[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            query, row, score = (x[place < self.k] for x in (query, row, score))
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(query + start)), pa.array(score), ids.take(pa.array(row))],
                ["key", "score", "ids"],
            )


def candidates(
    queries: np.ndarray, rows: np.ndarray, k: int, asked: np.ndarray, parts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all pairs that may be among the ``k`` best of a query in the parts it asks;
    rows are in order of their parts.

    Fast products differ from sums in order by rounding: pairs within that error of the k-th
    score stay in.
    """
    scores = np.full((len(queries), len(rows)), -np.inf)
    starts = np.flatnonzero(np.diff(parts, prepend=-1))
    for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
        who = np.flatnonzero(asked[:, parts[low]])
        if len(who):
            scores[who, low:high] = queries[who] @ rows[low:high].T
    compared = scores > -np.inf
    if len(rows) <= k:
        return np.nonzero(compared)
    least = np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k]
    lengths = np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max()
    error = lengths * (4e-16 * (rows.shape[1] + 4))
    return np.nonzero(compared & (scores >= (least - error)[:, None]))


def inner_products(
    queries: np.ndarray, rows: np.ndarray, query: np.ndarray, row: np.ndarray
) -> np.ndarray:
    """Sums in the order of the components, so that equal pairs have equal scores everywhere."""
    total = np.zeros(len(query))
    for i in range(rows.shape[1]):
        total += queries[query, i] * rows[row, i]
    return total

"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

A code is cut into segments, each about as long as the logarithm of the number of codes, and
every code is indexed by each of its segments. Codes at distance d from a query have a segment at
distance at most d / segments from the query's. So with segment radius r searched, all codes up
to distance segments * (r + 1) - 1 are known. The radius grows until that covers the k-th
neighbour found; queries that are done leave.

Equal codes are one entry. An entry keeps its k smallest ids, since ties go to the smallest id.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from switchboard.llm.common import stored

MAX_SEGMENT_BITS = 20
# Bits of a code kept in one number.
CHUNK_BITS = 31


def nearest_codes(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): for each query the k rows with the nearest codes.

    ``vectors`` has vec_id and embedding. Bit i of a code tells whether value i is above zero; a
    null or missing value counts as zero. Distance is the number of differing bits, ties go to the
    smaller id, and a query finds itself too. Where there are fewer than k rows all are returned.

    Rows without embedding have no code: they are neither found nor answered. Repeated rows are
    found and answered each for itself; a null id is the smallest id and never a query. Other
    columns are ignored, and an empty table gives no rows.
    """
    # Queries are told from the rows as given, before columns are chosen.
    rows = vectors.withColumn("__query", F.coalesce(is_query, F.lit(False)))
    rows = rows.select("vec_id", "embedding", F.col("__query").alias("is_query"))
    rows = rows.where("embedding is not null")
    facts = rows.agg(F.max(F.size("embedding")), F.count("*")).first()
    bits, n = int(facts[0] or 0), int(facts[1])
    width = max(4, min(MAX_SEGMENT_BITS, max(n, 2).bit_length() - 1))
    cuts = _segments(bits, width)
    chunks = [(at, min(at + CHUNK_BITS, bits)) for at in range(0, max(bits, 1), CHUNK_BITS)]
    coded = stored(
        rows.select(
            "vec_id", "is_query", _bits(chunks).alias("code"), _bits(cuts).alias("segments")
        ),
        "codes",
    )
    smallest = Window.partitionBy("code").orderBy("vec_id")
    entries = coded.select("code", "segments", "vec_id", F.row_number().over(smallest).alias("n"))
    entries = stored(entries.where(F.col("n") <= k), "code-ids")
    codes = entries.groupBy("code", "segments").agg(F.count("*").alias("rows"))
    index = stored(
        codes.select("code", "rows", F.posexplode("segments").alias("segment", "value")), "index"
    )
    queries = coded.where("is_query").select("vec_id", F.col("code").alias("query"), "segments")
    found = _search(queries.select("query", "segments").distinct(), index, cuts, bits, k)
    answers = _best_rows(found, entries, k)
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("query").alias("asked"))
    return asked.join(answers, F.col("asked") == F.col("query")).select(
        "query_id", "rank", "neighbor_id", "distance"
    )


def _segments(bits: int, width: int) -> list[tuple[int, int]]:
    """Segments of at most ``width`` bits whose lengths differ by one at most, longer ones first:
    a short segment would match a large share of all codes."""
    n = max(1, -(-bits // width))
    ends = [0]
    for i in range(n):
        ends.append(ends[-1] + bits // n + (i < bits % n))
    return list(zip(ends, ends[1:]))


def _bits(cuts: list[tuple[int, int]]) -> Column:
    """The bits of each cut as one number."""

    def number(low: int, high: int) -> Column:
        bits = [
            F.when(F.get("embedding", F.lit(i)) > 0, 1 << (i - low)).otherwise(0)
            for i in range(low, high)
        ]
        return sum(bits, F.lit(0)).cast("int")

    return F.array(*(number(*cut) for cut in cuts))


def _search(open_queries: DataFrame, index: DataFrame, cuts, bits: int, k: int) -> DataFrame:
    """(query, code, distance), with the k nearest rows of every query among them.

    With radius r - 1 searched in all segments, searching radius r in so many of them covers as
    many more distances. A query whose k-th known neighbour is at distance ``most`` therefore asks
    only the segments it needs, and keeps only what is no farther.
    """
    nothing = [F.col("query"), F.col("query").alias("code"), F.lit(0).cast("long").alias("rows")]
    known = open_queries.select(*nothing, F.lit(0).cast("long").alias("distance")).limit(0)
    open_queries = open_queries.withColumn("most", F.lit(bits).cast("long"))
    for radius in range(cuts[0][1] - cuts[0][0] + 1):
        open_queries = stored(open_queries, "open-queries")
        if open_queries.isEmpty():
            break
        needed = F.col("most") + 1 - len(cuts) * radius
        probes = open_queries.select(
            "query", "most", needed.alias("needed"), F.posexplode("segments").alias("at", "own")
        ).where(F.col("at") < F.col("needed"))
        probes = probes.withColumn("flipped", F.explode(_flips(cuts, radius))).select(
            "query", "most", "at", F.col("own").bitwiseXOR(F.col("flipped")).alias("probe")
        )
        near = _distance(bits) <= F.col("most")
        same = (F.col("at") == F.col("segment")) & (F.col("probe") == F.col("value"))
        # A probe is made per mask, but its table is judged by the size of the queries' file: it
        # would be broadcast whatever its size.
        met = probes.hint("merge").join(index, same & near)
        met = met.select("query", "code", "rows", _distance(bits).alias("distance"))
        # A code may be met again through another segment.
        known = stored(known.unionByName(met).distinct(), "met")
        reach = stored(_reach(known, bits, k), "reach")
        known = known.join(reach, "query").where(F.col("distance") <= F.col("most")).drop("most")
        later = F.coalesce("most", F.lit(bits)) + 1 - len(cuts) * (radius + 1) > 0
        open_queries = (
            open_queries.drop("most")
            .join(reach, "query", "left")
            .where(later)
            .withColumn("most", F.coalesce("most", F.lit(bits)).cast("long"))
        )
    return known.select("query", "code", "distance")


def _reach(known: DataFrame, bits: int, k: int) -> DataFrame:
    """(query, most): the distance of the k-th known row, or the largest there is.

    Distances are few, so a query has few rows in the running sums.
    """
    counts = known.groupBy("query", "distance").agg(F.sum("rows").alias("n"))
    nearer = Window.partitionBy("query").orderBy("distance")
    counts = counts.withColumn("so_far", F.sum("n").over(nearer))
    enough = F.min(F.when(F.col("so_far") >= k, F.col("distance")))
    return counts.groupBy("query").agg(F.coalesce(enough, F.lit(bits).cast("long")).alias("most"))


def _flips(cuts: list[tuple[int, int]], radius: int) -> Column:
    """The masks of ``radius`` bits that fit the segment."""

    def masks(cut: tuple[int, int]) -> Column:
        places = range(cut[1] - cut[0])
        found = [sum(1 << b for b in chosen) for chosen in combinations(places, radius)]
        return F.lit(found) if found else F.array().cast("array<int>")

    longest = cuts[0][1] - cuts[0][0]
    n_long = sum(high - low == longest for low, high in cuts)
    return F.when(F.col("at") < n_long, masks(cuts[0])).otherwise(masks(cuts[-1]))


def _distance(bits: int) -> Column:
    parts = [
        F.bit_count(F.get("query", F.lit(i)).bitwiseXOR(F.get("code", F.lit(i))))
        for i in range(max(1, -(-bits // CHUNK_BITS)))
    ]
    return sum(parts, F.lit(0)).cast("long")


def _best_rows(found: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("distance", "neighbor_id")
    ids = entries.select("code", F.col("vec_id").alias("neighbor_id"))
    each = found.join(ids, "code").select("query", "neighbor_id", "distance")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("rank", F.col("rank").cast("long"))

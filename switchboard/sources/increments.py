"""A stored call graph that follows its source files: an update joins only what changed.

A version holds the rows of the files that changed in it, and by how much three counts changed:

* ``edges``: call rows per (caller, callee, written name);
* ``callers_by_name``, ``callees_by_name``: how many (edge, name) pairs an answer row follows from.

An answer is there while its sum over the versions is above 0, so a row that goes takes with it
exactly the answers that nothing else supports. An edge gives the same answers as before unless it
came or went or a method at one of its ends changed; an update joins only the edges that may not,
once with the methods as they were and once as they are. ``files`` is the whole list of files, each
with a fingerprint of its rows and the version that holds them; ``chain`` lists the versions to be
read and is written last, so an update that did not end is no part of any chain.

Rows count in the order of their file's path and, within it, of ``seq``; so a file that grows does
not move the rows of others. A method row belongs to its ``file``, a call row to its
``callsite_file``; null is the file "".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchboard.operators.adjacency import callee_rows, caller_rows
from switchboard.operators.graph import CallGraph
from switchboard.operators.skew import stored
from switchboard.schema import CALL_COLUMNS, METHOD_COLUMNS
from switchboard.sources.snapshot import ANSWERS, latest_version

UNIT = {"method_rows": "file", "calls": "callsite_file"}
EDGE = ["caller_id", "callee_id", "callee_full_name"]
VERSIONED = {"unit": "string", "version": "int"}
COLUMNS = {
    "method_rows": dict.fromkeys(METHOD_COLUMNS, "string") | {"seq": "bigint"} | VERSIONED,
    "calls": dict.fromkeys(CALL_COLUMNS, "string") | VERSIONED,
    "edges": dict.fromkeys(EDGE, "string") | {"n": "bigint", "version": "int"},
    **{name: dict.fromkeys(keys, "string") | {"n": "bigint"} for name, keys in ANSWERS.items()},
    "files": {"kind": "string", "unit": "string", "print": "string", "version": "int"},
    "chain": {"version": "int"},
}
# Versions that are read together before they are written as one.
MAX_VERSIONS = 16


def create(graph: CallGraph, path: str, version: int = 1) -> int:
    """Write all of a graph as the first version; ``seq`` must be a number."""
    rows = _with_units(graph)
    return _write_whole(graph.spark, path, rows, _prints(rows), version)


def update(graph: CallGraph, path: str, max_versions: int = MAX_VERSIONS) -> int:
    """Bring the stored graph to the state of ``graph`` and return the version that has it.

    All rows of ``graph`` are read once for their fingerprints, and none is shuffled for that;
    what follows reads the rows of changed files. Without a stored graph, all of it is written.
    """
    spark = graph.spark
    if not _latest(spark, path):
        return create(graph, path)
    rows = _with_units(graph)
    return _apply(spark, path, rows, _differences(spark, path, _prints(rows)), max_versions)


def update_files(
    graph: CallGraph, files: DataFrame, path: str, max_versions: int = MAX_VERSIONS
) -> int:
    """As ``update``, where ``files(file)`` lists all changed, new and removed files and ``graph``
    has the rows of these files only. Rows of files that are not listed are ignored."""
    spark = graph.spark
    listed = files.select(F.coalesce("file", F.lit("")).alias("unit")).distinct()
    kinds = F.explode(F.array(*map(F.lit, UNIT))).alias("kind")
    listed = stored(listed.select(kinds, "unit"), "listed-files")
    rows = {
        kind: own.join(listed.where(F.col("kind") == kind), "unit", "left_semi")
        for kind, own in _with_units(graph).items()
    }
    differences = _differences(spark, path, _prints(rows))
    changed = differences.join(listed, ["kind", "unit"], "left_semi")
    return _apply(spark, path, rows, changed, max_versions)


def open_graph(spark: SparkSession, path: str, out_dir: str | None = None) -> CallGraph:
    """The graph of the latest version. Answers by name read few row groups, as in a snapshot: the
    filter on the name goes below the sums."""
    version, chain = _state(spark, path)
    rows = {kind: _live(spark, path, kind, version, chain) for kind in UNIT}
    graph = _graph(rows["method_rows"], rows["calls"].select(CALL_COLUMNS), out_dir)
    for name, keys in ANSWERS.items():
        counts = _read(spark, path, name, chain)
        if len(chain) > 1:
            counts = counts.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")
        setattr(graph, name, counts.select(*keys))
    return graph


def compact(spark: SparkSession, path: str) -> int:
    """Write the state of the latest version as one."""
    version, chain = _state(spark, path)
    if len(chain) == 1:
        return version
    rows = {kind: _live(spark, path, kind, version, chain) for kind in UNIT}
    files = _read(spark, path, "files", [version]).where("print is not null")
    return _write_whole(spark, path, rows, files.select("kind", "unit", "print"), version + 1)


# Files and fingerprints


def _with_units(graph: CallGraph) -> dict[str, DataFrame]:
    rows = {"method_rows": graph.method_rows, "calls": graph.calls}
    return {
        kind: own.withColumn("unit", F.coalesce(UNIT[kind], F.lit(""))).select(
            *(F.col(c).cast(t).alias(c) for c, t in COLUMNS[kind].items() if c != "version")
        )
        for kind, own in rows.items()
    }


def _prints(rows: dict[str, DataFrame]) -> DataFrame:
    """(kind, unit, print), one row per file, summed before the shuffle.

    Sums of row hashes do not depend on order or partitions. For methods also the order counts:
    sum(hash * (seq - first seq)) tells it, and needs no row of a file to meet another.
    """
    prints = []
    for kind, own in rows.items():
        columns = METHOD_COLUMNS if kind == "method_rows" else CALL_COLUMNS
        # A null is a value of its own; the hash functions of Spark pass over nulls.
        values = [F.struct(F.col(c).isNull(), F.coalesce(c, F.lit(""))) for c in columns]
        hashes = [F.xxhash64(F.lit(seed), *values) for seed in (1, 2)]
        sums: list[Column] = [F.count("*")]
        sums += [F.sum(h.cast("decimal(20,0)")) for h in hashes]
        if kind == "method_rows":
            seq, first = (c.cast("decimal(20,0)") for c in (F.col("seq"), F.min("seq")))
            for h in hashes:
                small = F.shiftrightunsigned(h, 33).cast("decimal(10,0)")
                sums.append(F.sum(small * seq) - first * F.sum(small))
        text = F.concat_ws(",", *(F.coalesce(s.cast("string"), F.lit("-")) for s in sums))
        counted = own.groupBy("unit").agg(text.alias("print"))
        prints.append(counted.select(F.lit(kind).alias("kind"), "unit", "print"))
    return prints[0].unionByName(prints[1])


def _differences(spark: SparkSession, path: str, prints: DataFrame) -> DataFrame:
    """(kind, unit, print) of files whose rows are not the stored ones; a null print: no rows."""
    version, _ = _state(spark, path)
    before = _read(spark, path, "files", [version]).select(
        "kind", "unit", F.col("print").alias("before")
    )
    both = before.join(prints, ["kind", "unit"], "full")
    return both.where(~F.col("before").eqNullSafe(F.col("print"))).select("kind", "unit", "print")


# Versions


def _latest(spark: SparkSession, path: str) -> int:
    return latest_version(spark, path, last_table="chain")


def _state(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The latest version, and the versions that make it up, at most ``MAX_VERSIONS``."""
    version = _latest(spark, path)
    if not version:
        raise FileNotFoundError(f"No stored graph in '{path}'")
    rows = _read(spark, path, "chain", [version]).collect()
    return version, sorted(row.version for row in rows)


def _read(spark: SparkSession, path: str, name: str, versions: list[int]) -> DataFrame:
    schema = ", ".join(f"`{c}` {t}" for c, t in COLUMNS[name].items())
    return spark.read.schema(schema).parquet(*(f"{path}/version={v}/{name}" for v in versions))


def _write(rows: DataFrame, path: str, version: int, name: str) -> None:
    if "version" in COLUMNS[name] and "version" not in rows.columns:
        rows = rows.withColumn("version", F.lit(version))
    rows = rows.select(*(F.col(c).cast(t).alias(c) for c, t in COLUMNS[name].items()))
    if name in ANSWERS:
        rows = rows.repartitionByRange(*ANSWERS[name]).sortWithinPartitions(*ANSWERS[name])
    rows.write.mode("overwrite").parquet(f"{path}/version={version}/{name}")


def _live(
    spark: SparkSession, path: str, kind: str, version: int, chain: list[int]
) -> DataFrame:
    """The rows of a version: of each file, those of the version that wrote it last."""
    rows = _read(spark, path, kind, chain)
    if len(chain) == 1:
        return rows
    files = _read(spark, path, "files", [version])
    # Only files that changed after the first version, so that the side to look in is small.
    later = files.where((F.col("kind") == kind) & (F.col("version") > chain[0])).select(
        F.col("unit").alias("later_unit"), F.col("version").alias("later_version")
    )
    older = (F.col("unit") == F.col("later_unit")) & (F.col("version") < F.col("later_version"))
    return rows.join(later, older, "left_anti")


def _graph(method_rows: DataFrame, calls: DataFrame, out_dir: str | None = None) -> CallGraph:
    place = F.struct("unit", "seq").alias("seq")
    return CallGraph(method_rows.select(*METHOD_COLUMNS, place), calls, out_dir)


def _write_whole(
    spark: SparkSession, path: str, rows: dict[str, DataFrame], prints: DataFrame, version: int
) -> int:
    for kind, own in rows.items():
        _write(own.drop("version"), path, version, kind)
    read = {kind: _read(spark, path, kind, [version]) for kind in rows}
    counts = read["calls"].groupBy(*EDGE).agg(F.count("*").alias("n"))
    _write(counts, path, version, "edges")
    edges = _read(spark, path, "edges", [version]).select(*EDGE)
    for name, counts in _supports(_graph(read["method_rows"], edges)).items():
        _write(counts, path, version, name)
    _write(prints, path, version, "files")
    _write(spark.range(1).select(F.lit(version).alias("version")), path, version, "chain")
    return version


def _supports(graph: CallGraph) -> dict[str, DataFrame]:
    """Per answer row the (edge, name) pairs that it follows from; the calls are distinct edges."""
    found = {"callers_by_name": caller_rows, "callees_by_name": callee_rows}
    return {
        name: rows(graph, graph.calls, graph.names)
        .groupBy(*ANSWERS[name])
        .agg(F.count("*").alias("n"))
        for name, rows in found.items()
    }


def _apply(
    spark: SparkSession,
    path: str,
    rows: dict[str, DataFrame],
    changed: DataFrame,
    max_versions: int,
) -> int:
    changed = stored(changed, "changed-files")
    before, chain = _state(spark, path)
    if changed.isEmpty():
        return before
    version = latest_version(spark, path, complete_only=False) + 1

    for kind, own in rows.items():
        of_kind = changed.where((F.col("kind") == kind) & F.col("print").isNotNull())
        _write(own.join(of_kind, "unit", "left_semi"), path, version, kind)
    files = _read(spark, path, "files", [before]).join(changed, ["kind", "unit"], "left_anti")
    now = changed.withColumn("version", F.lit(version))
    _write(files.unionByName(now), path, version, "files")

    def changed_rows(kind: str, *columns: str) -> DataFrame:
        """Rows of changed files as they were, n = -1, and as they are, n = 1."""
        of_kind = changed.where(F.col("kind") == kind)
        old = _live(spark, path, kind, before, chain).join(of_kind, "unit", "left_semi")
        new = _read(spark, path, kind, [version])
        return old.select(*columns, F.lit(-1).alias("n")).unionByName(
            new.select(*columns, F.lit(1).alias("n"))
        )

    edges = changed_rows("calls", *EDGE).groupBy(*EDGE).agg(F.sum("n").alias("n")).where("n <> 0")
    _write(edges, path, version, "edges")
    methods = stored(changed_rows("method_rows", "method_id").select("method_id").distinct(), "ids")

    touched = _touched(spark, path, methods, chain, version)
    ends = touched.select(F.explode(F.array("caller_id", "callee_id")).alias("method_id"))
    ends = stored(ends.where("method_id is not null").distinct(), "ends")
    supports = []
    for sign, had, at, versions in (
        (-1, "before", before, chain),
        (1, "after", version, [*chain, version]),
    ):
        own = _live(spark, path, "method_rows", at, versions).join(ends, "method_id", "left_semi")
        own = stored(own, "methods-at-ends")
        found = _supports(_graph(own, touched.where(f"{had} > 0").select(*EDGE)))
        supports.append({name: c.withColumn("n", c.n * sign) for name, c in found.items()})
    for name, keys in ANSWERS.items():
        both = supports[0][name].unionByName(supports[1][name])
        change = both.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")
        _write(change, path, version, name)

    versions = spark.createDataFrame([(v,) for v in [*chain, version]], "version int")
    _write(versions, path, version, "chain")
    return version if len(chain) < max_versions else compact(spark, path)


def _touched(
    spark: SparkSession, path: str, methods: DataFrame, chain: list[int], version: int
) -> DataFrame:
    """(<edge>, before, after): call rows of each edge that may give other answers now: edges that
    came or went, and all edges with a changed method at an end. Edges are looked at where they
    are read, by their callers; only those found are shuffled, and of these the ones that were
    there and still are, between the same methods, are dropped."""
    new = _read(spark, path, "edges", [version])
    by_edge = new.select("caller_id", F.lit(0).alias("by_caller"))
    by_method = methods.select(F.col("method_id").alias("caller_id"), F.lit(1).alias("by_caller"))
    callers = by_edge.unionByName(by_method).groupBy("caller_id").agg(F.max("by_caller").alias("by_caller"))
    callees = methods.select(F.col("method_id").alias("callee_id"), F.lit(1).alias("by_callee"))
    edges = _read(spark, path, "edges", [*chain, version])
    found = edges.join(stored(callers, "callers"), "caller_id", "left").join(
        callees, "callee_id", "left"
    )
    # A caller without an id makes no answer, so that none of its edges is needed.
    found = found.where("by_caller is not null or by_callee is not null")
    old = F.when(F.col("version") < version, F.col("n")).otherwise(0)
    counts = [F.sum(old).alias("before"), F.sum("n").alias("after")]
    counts.append(F.max(F.greatest("by_caller", "by_callee")).alias("by_method"))
    summed = found.groupBy(*EDGE).agg(*counts)
    touched = summed.where("by_method = 1 or (before > 0) <> (after > 0)").drop("by_method")
    return stored(touched, "touched-edges")

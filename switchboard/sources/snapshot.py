"""A written, typed snapshot of a call graph.

CSV is read once; queries then run on Parquet. Both directions are stored by short name, clustered
by it, so a question about one function skips the row groups of all others. Each save
makes a new version, and a version counts only once its last table is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from switchboard.operators.adjacency import callees_all, callers_all
from switchboard.operators.graph import CallGraph
from switchboard.operators.lookup import name_parts
from switchboard.sources.tables import path_exists

# Table name to the columns its rows are clustered by. Range bounds cover all the columns, so
# a key with very many rows is divided over several files.
READ_TABLES = {"method_rows": ["method_id", "seq"], "calls": []}
KEYED_TABLES = {"methods": ["method_id"], "names": ["fn", "method_id"]}
# The index is asked for a few parts at a time, so its row groups are small.
INDEX = {"name_parts": ["part", "fn"]}
INDEX_ROW_GROUP = 1 << 20
ANSWERS = {"callers_by_name": ["fn", "caller"], "callees_by_name": ["fn", "callee"]}
LAST_TABLE = "callees_by_name"


def save(graph: CallGraph, path: str) -> int:
    """Write a new version and return its number."""
    spark = graph.spark
    version = latest_version(spark, path, complete_only=False) + 1
    folder = f"{path}/version={version}"
    _write({name: getattr(graph, name) for name in READ_TABLES}, READ_TABLES, folder)
    # The source is read once; the other tables come from what was just stored.
    read = CallGraph(*(spark.read.parquet(f"{folder}/{name}") for name in READ_TABLES))
    _write({name: getattr(read, name) for name in KEYED_TABLES}, KEYED_TABLES, folder)
    vars(read).update({name: spark.read.parquet(f"{folder}/{name}") for name in KEYED_TABLES})
    _write({"name_parts": name_parts(read.names)}, INDEX, folder)
    answers = {"callers_by_name": callers_all(read), "callees_by_name": callees_all(read)}
    _write(answers, ANSWERS, folder)
    return version


def _write(tables: dict[str, DataFrame], layout: dict[str, list[str]], folder: str) -> None:
    for name, keys in layout.items():
        rows = tables[name]
        if keys:
            rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        writer = rows.write
        if name in INDEX:
            writer = writer.option("parquet.block.size", INDEX_ROW_GROUP)
        writer.parquet(f"{folder}/{name}")


def latest_version(
    spark: SparkSession, path: str, complete_only: bool = True, last_table: str = LAST_TABLE
) -> int:
    """The highest version number, 0 when there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not file_system.exists(root):
        return 0
    names = [status.getPath().getName() for status in file_system.listStatus(root)]
    versions = [int(n.split("=")[1]) for n in names if n.startswith("version=")]
    if complete_only:
        versions = [
            v for v in versions if path_exists(spark, f"{path}/version={v}/{last_table}/_SUCCESS")
        ]
    return max(versions, default=0)


def open_snapshot(spark: SparkSession, path: str, out_dir: str | None = None) -> CallGraph:
    """The graph of the latest complete version."""
    version = latest_version(spark, path)
    if not version:
        raise FileNotFoundError(f"No snapshot in '{path}'")
    folder = f"{path}/version={version}"
    tables = {
        name: spark.read.parquet(f"{folder}/{name}")
        for name in READ_TABLES | KEYED_TABLES | INDEX | ANSWERS
        # A version written before there was an index has none.
        if name not in INDEX or path_exists(spark, f"{folder}/{name}/_SUCCESS")
    }
    graph = CallGraph(tables.pop("method_rows"), tables.pop("calls"), out_dir)
    vars(graph).update(tables)  # stored tables take the place of the derived ones
    return graph


def load_once(
    spark: SparkSession, out_dir: str, snapshot_path: str, refresh: bool = False
) -> CallGraph:
    """The snapshot of the CSV tables in ``out_dir``; they are read again only on ``refresh``."""
    if refresh or not latest_version(spark, snapshot_path):
        save(CallGraph.from_csv(spark, out_dir), snapshot_path)
    return open_snapshot(spark, snapshot_path, out_dir)

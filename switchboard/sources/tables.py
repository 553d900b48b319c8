"""The two CSV tables of a call graph, read from and written to any Hadoop file system."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchboard.schema import (
    CALL_COLUMNS,
    CALLS_FILE,
    METHOD_COLUMNS,
    METHODS_FILE,
    OUT_DIR_VARIABLE,
)
from switchboard.sources.quoted_csv import read_quoted_csv

# Columns without which no query can run; the others default to the empty string.
REQUIRED_METHOD_COLUMNS = ["method_id", "full_name"]
REQUIRED_CALL_COLUMNS = ["caller_id", "callee_id"]

WRITE_OPTIONS = {
    "header": True,
    "quoteAll": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def default_out_dir() -> str:
    """The configured folder, else ``out`` in the working folder of the default file system."""
    return os.environ.get(OUT_DIR_VARIABLE, "out")


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return file_system.exists(hadoop_path)


def check_tables(spark: SparkSession, out_dir: str) -> None:
    """Both tables must be there before either is read."""
    for name in (METHODS_FILE, CALLS_FILE):
        if not path_exists(spark, os.path.join(out_dir, name)):
            raise FileNotFoundError(
                f"'{out_dir}' has no complete call graph: it needs {METHODS_FILE} and {CALLS_FILE}"
            )


def read_methods(spark: SparkSession, out_dir: str, multi_line: bool | None = None) -> DataFrame:
    """Method rows as strings, with their file order as ``seq``."""
    check_tables(spark, out_dir)
    path = os.path.join(out_dir, METHODS_FILE)
    rows = read_quoted_csv(spark, path, multi_line)
    return _select(rows, METHOD_COLUMNS, REQUIRED_METHOD_COLUMNS, path, ["seq"])


def read_calls(spark: SparkSession, out_dir: str, multi_line: bool | None = None) -> DataFrame:
    """Call rows as strings; a multiset whose order no query observes."""
    check_tables(spark, out_dir)
    path = os.path.join(out_dir, CALLS_FILE)
    rows = read_quoted_csv(spark, path, multi_line)
    return _select(rows, CALL_COLUMNS, REQUIRED_CALL_COLUMNS, path, [])


def _select(
    rows: DataFrame, columns: list[str], required: list[str], path: str, extra: list[str]
) -> DataFrame:
    missing = [c for c in required if c not in rows.columns]
    if missing and rows.columns != ["seq"]:  # an empty file has no header and no rows
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    empty = F.lit("")
    present = [
        (F.coalesce(F.col(c), empty) if c in rows.columns else empty).alias(c) for c in columns
    ]
    return rows.select(*present, *extra)


def write_methods(method_rows: DataFrame, out_dir: str) -> None:
    """Write the methods table; ``seq``, when there is one, decides the order of the rows."""
    ordered = method_rows.orderBy("seq") if "seq" in method_rows.columns else method_rows
    _write(ordered.select(*METHOD_COLUMNS), os.path.join(out_dir, METHODS_FILE))


def write_calls(calls: DataFrame, out_dir: str) -> None:
    _write(calls.select(*CALL_COLUMNS), os.path.join(out_dir, CALLS_FILE))


def _write(rows: DataFrame, path: str) -> None:
    strings = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns]
    rows.select(*strings).write.mode("overwrite").options(**WRITE_OPTIONS).csv(path)

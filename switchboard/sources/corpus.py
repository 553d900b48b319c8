"""A folder of source files as a table ``(path, source)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """Every matching file below ``root``, with its path relative to ``root``.

    Sources stay bytes, so that each file's own encoding declaration is honoured.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(root)
    )
    hadoop_root = spark._jvm.org.apache.hadoop.fs.Path(root)
    file_system = hadoop_root.getFileSystem(spark._jsc.hadoopConfiguration())
    prefix = file_system.makeQualified(hadoop_root).toString().rstrip("/") + "/"
    relative = F.substring("path", F.lit(len(prefix) + 1), F.length("path"))
    return files.select(relative.alias("path"), F.col("content").alias("source"))

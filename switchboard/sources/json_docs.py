"""JSON documents: one object per line for tables, or one indented object per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def save_json(documents: DataFrame, path: str) -> None:
    """Write every row as one JSON object; nulls are kept as nulls."""
    documents.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def load_json(
    spark: SparkSession, path: str, schema: StructType | str | None = None, indented: bool = False
) -> DataFrame:
    """Read JSON objects; ``indented`` when each file is a single object over several lines.

    Without a schema the text is read twice, once to infer it.
    """
    reader = spark.read.option("multiLine", indented)
    return (reader.schema(schema) if schema else reader).json(path)

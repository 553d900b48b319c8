"""Tables, written intermediate results and text batches shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchboard.session import scratch_path

ARROW_ROWS, DEFAULT_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
# Text handled at once by the vectorised passes; a longer document is handled alone.
SLICE_BYTES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(rows: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read back: lost executors do not lose them."""
    spark = rows.sparkSession
    path = scratch_path(spark, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def ask_small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Whole texts make large Arrow batches, which JVM and Python hold several times over: fewer
    rows to a batch, unless the session has its own setting."""
    if spark.conf.get(ARROW_ROWS) == DEFAULT_ARROW_ROWS:
        spark.conf.set(ARROW_ROWS, str(rows))


def text_id(text: str = "text") -> Column:
    """With the document id, this tells apart rows that repeat an id with another text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the named columns, so that no other column can clash; a null text is empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def fold(remainder: int, parts: int, column: str = "doc_id") -> Column:
    """Whether a row belongs to the held-out part; a null id never does."""
    crc = F.crc32(F.col(column).cast("string").cast("binary"))
    return F.coalesce(crc % parts == remainder, F.lit(False))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    use: Callable[[str], Column],
    max_rows: int,
) -> DataFrame:
    """(text, label) of at most ``max_rows`` labelled documents whose id ``use`` accepts.

    They are those with the smallest hashes of their ids, so the choice is the same each time.
    Rows without id or label are left out; of labels that repeat an id the largest counts, of
    documents that repeat one the smallest text. Only ids and labels of the sample are broadcast.
    """
    known = labels.select(F.col("doc_id").alias("labelled_id"), F.col(label).alias("label"))
    known = known.where("labelled_id is not null and label is not null")
    known = known.groupBy("labelled_id").agg(F.max("label").alias("label"))
    known = known.where(use("labelled_id"))
    chosen = known.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(max_rows)
    rows = id_and_text(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label")


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about SLICE_BYTES of text each."""
    ends = np.cumsum(byte_lengths(batch.column(text)))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def byte_lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each begins; nulls are empty."""
    lengths = byte_lengths(texts).astype(np.int64)
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    values = texts.cast(pa.large_binary())
    joined = b"".join(value.as_buffer() for value in values if value.is_valid)
    return np.frombuffer(joined, np.uint8), offsets

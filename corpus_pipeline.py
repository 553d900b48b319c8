"""From raw documents to packed training sequences, as stages that are written one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchboard.llm import decontam, line_dedup, near_dedup, packing, quality
from switchboard.llm.common import fold, stored, table, text_id

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = table(spark, sf_dir, "labels")
    found = quality.score_quality(docs, labels, lambda doc_id: ~fold(2, 4, doc_id))
    return found.where(F.col("predicted") == 1).select("doc.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines shared by many documents stay in one of them."""
    found = line_dedup.dedup_lines(docs)
    changes = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return found.select(*(changes.get(c, F.col(f"doc.{c}")).alias(c) for c in docs.columns))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    found = near_dedup.near_duplicates(docs).where(~F.col("kept"))
    dropped = found.select(F.col("doc_id").alias("id"), F.col("text_id").alias("its_text"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (text_id() == F.col("its_text"))
    return docs.join(dropped, same, "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of one length."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("line_dedup", dedup_lines),
    ("near_dedup", keep_one_of_near),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

# The first stage is a learned classifier and the last a tokenizer: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

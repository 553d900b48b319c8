"""Equi-joins that stay balanced when a few keys hold a large share of the rows.

A key is heavy when it holds more rows than one task should process. Heavy keys are found by one
pre-aggregated count and written to the shared folder, so that every use sees the same keys; there
are at most (all rows) / (rows of a task) of them. ``skew_join`` spreads the left rows of a heavy
key over ``ceil(rows / rows_per_task)`` salts and repeats the matching right rows once per salt;
all other keys join as usual. It reads the left side once, and needs left rows that differ from
each other. It changes only where rows are processed, never which rows come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from switchboard.session import scratch_path

ROWS_PER_TASK_CONF = "spark.switchboard.rowsPerTask"
ROWS_PER_TASK = 5_000_000
# Keys and ids are hex texts, which the default codec of Parquet leaves as long as they are.
STORED_CODEC = "zstd"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Heavy keys up to which their table is broadcast; a longer table is joined by shuffles.
MAX_BROADCAST_KEYS = 100_000


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_TASK_CONF, str(ROWS_PER_TASK)))


def stored(rows: DataFrame, label: str) -> DataFrame:
    """The rows, written once to the shared folder and read back."""
    path = scratch_path(rows.sparkSession, label)
    write_shuffled(rows.write.option("compression", STORED_CODEC), rows.sparkSession, path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_shuffled(writer: DataFrameWriter, spark: SparkSession, path: str) -> None:
    """Write Parquet and drop the shuffle files of this write, which nothing reads again; else they
    stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        writer.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)


def count_rows(*tables: DataFrame) -> list[int]:
    """Rows of each table, in one job; for Parquet tables read from file footers."""
    counts = [table.agg(F.count("*")).scalar() for table in tables]
    return list(tables[0].sparkSession.range(1).select(*counts).first())


def find_heavy_keys(rows: DataFrame, key: str, total: int | None = None) -> DataFrame | None:
    """(heavy_key, salts) of the heavy keys, or None when there can be none.

    ``total`` bounds the rows of any key, so a table below the limit needs no count per key.
    """
    limit = rows_per_task(rows.sparkSession)
    if total is None:
        (total,) = count_rows(rows)
    if total <= limit:
        return None
    counts = rows.groupBy(F.col(key).alias("heavy_key")).agg(F.count("*").alias("n"))
    heavy = counts.where((F.col("n") > limit) & F.col("heavy_key").isNotNull())
    heavy = stored(
        heavy.select("heavy_key", F.ceil(F.col("n") / limit).cast("int").alias("salts")), "heavy"
    )
    return F.broadcast(heavy) if total // limit <= MAX_BROADCAST_KEYS else heavy


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: tuple[str, str],
    spread: list[str],
    how: str = "inner",
    heavy: DataFrame | None = None,
    heavy_on: tuple[str, str] | None = None,
    right_heavy: DataFrame | None = None,
    right_spread: list[str] | None = None,
) -> DataFrame:
    """Join ``left`` and ``right`` on ``on = (left column, right column)``.

    ``spread`` are the left columns whose hash picks the salt of a heavy row. ``heavy_on`` names
    the columns that heavy keys refer to when they are coarser than the join key. ``right_heavy``
    does the same for a right side that may repeat a key; inner joins only. The column names of
    the two sides must be disjoint; the result has all of them.
    """
    left_key, right_key = on
    left_heavy_on, right_heavy_on = heavy_on or on
    salts = []
    columns = left.columns if how == "left_semi" else left.columns + right.columns

    if heavy is not None:
        left = _add_salt(left, heavy, left_heavy_on, spread, "left_salt")
        right = _repeat_per_salt(right, heavy, right_heavy_on, "right_salt")
        salts.append(("left_salt", "right_salt"))
    if right_heavy is not None:
        if how != "inner":
            raise ValueError("a heavy right side needs an inner join")
        right = _add_salt(right, right_heavy, right_key, right_spread, "right_own_salt")
        left = _repeat_per_salt(left, right_heavy, left_key, "left_copy_salt")
        salts.append(("left_copy_salt", "right_own_salt"))

    condition = F.col(left_key) == F.col(right_key)
    for ours, theirs in salts:
        condition = condition & (F.col(ours) == F.col(theirs))
    return left.join(right, condition, how).select(*columns)


def _add_salt(
    rows: DataFrame, heavy: DataFrame, key: str, spread: list[str], salt: str
) -> DataFrame:
    rows = rows.join(heavy, F.col(key) == F.col("heavy_key"), "left")
    own = F.pmod(F.xxhash64(*spread), F.col("salts")).cast("int")
    value = F.when(F.col("salts").isNotNull(), own).otherwise(F.lit(0))
    return rows.withColumn(salt, value).drop("heavy_key", "salts")


def _repeat_per_salt(rows: DataFrame, heavy: DataFrame, key: str, salt: str) -> DataFrame:
    salts: Column = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    rows = rows.join(heavy, F.col(key) == F.col("heavy_key"), "left")
    return rows.withColumn(salt, F.explode(salts)).drop("heavy_key", "salts")

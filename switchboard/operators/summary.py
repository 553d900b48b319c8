"""Sum, mean, population deviation, z-scores and comparison of numeric data sets.

A data set is the rows of one group; no group columns means the whole table is one data set.
Null values are outside the contract and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from switchboard.operators.skew import stored

# Integers are summed in this type, whose sums have 38 digits: the sum of a large data set need not
# be an integer of 64 bits.
SUMMED = "decimal(28,0)"


def _aggregates(values: DataFrame, name: str) -> list[Column]:
    value = F.col(name)
    is_integer = isinstance(values.schema[name].dataType, IntegralType)
    summed = value.cast(SUMMED) if is_integer else value
    return [
        F.count("*").alias("n"),
        F.coalesce(F.sum(summed), F.lit(0)).alias("total"),  # integer sums stay exact
        F.coalesce(F.avg(value), F.lit(0.0)).alias("average"),
        F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std_dev"),
        (F.min(value) == F.max(value)).alias("constant"),
    ]


def statistics(values: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Total, average and standard deviation per data set; zeros for an empty one."""
    by_columns = [by] if by else []
    present = values.where(F.col(value).isNotNull())
    columns = [*by_columns, "total", "average", "std_dev"]
    return present.groupBy(*by_columns).agg(*_aggregates(present, value)).select(*columns)


def with_integer_totals(stats: DataFrame) -> DataFrame:
    """Exact totals as 64-bit integers where every one is within their range, else as they are."""
    stats = stored(stats, "statistics")
    limits = F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)")
    beyond = stats.where(~F.col("total").between(*limits))
    return stats.withColumn("total", F.col("total").cast("bigint")) if beyond.isEmpty() else stats


def statistics_for(values: DataFrame, value: str, by: str, requests: DataFrame) -> DataFrame:
    """Statistics of the requested data sets; one without rows gets zeros."""
    wanted = requests.select(F.col(by).alias("wanted")).distinct()
    found = wanted.join(statistics(values, value, by), F.col("wanted") == F.col(by), "left")
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "average", "std_dev")]
    return found.select(F.col("wanted").alias(by), *zeros)


def analyze(values: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Every row of ``values`` with its z-score and the statistics of its data set; rows without
    a group are a data set too.

    A data set whose values are all equal has no deviation and keeps its values. Statistics are
    pre-aggregated, one row per data set, written and joined back: a window would put a whole data
    set into one task, and a join of the rows with a written table is one that adaptive execution
    splits where a data set is large.
    """
    present = values.where(F.col(value).isNotNull())
    names = ("total", "average", "std_dev", "constant")
    if by is None:
        stats = present.agg(*_aggregates(present, value)).select(F.struct(*names))
        joined = present.withColumn("stats", stats.scalar()).select("*", "stats.*").drop("stats")
    else:
        grouped = present.groupBy(F.col(by).alias("set_key")).agg(*_aggregates(present, value))
        stats = stored(grouped.select("set_key", *names), "statistics")
        joined = present.join(stats, F.col(by).eqNullSafe(F.col("set_key")))
    x = F.col(value).cast("double")
    unchanged = F.col("constant") | (F.col("std_dev") == 0)
    normalized = F.when(unchanged, x).otherwise((x - F.col("average")) / F.col("std_dev"))
    return joined.select(
        *values.columns,
        normalized.alias("normalized"),
        "total",
        F.col("average").alias("mean"),
        "average",
        "std_dev",
    )


def zscore(values: DataFrame, value: str, by: str | None = None) -> DataFrame:
    return analyze(values, value, by).select(*values.columns, "normalized")


def compare_pairs(values: DataFrame, value: str, by: str, pairs: DataFrame) -> DataFrame:
    """Compare the data sets named by each row of ``pairs(dataset1, dataset2)``.

    ``values`` collapses to one row per data set, written, before any join.
    """
    stats = stored(statistics(values, value, by), "statistics")
    for side in ("1", "2"):
        renamed = stats.select(
            F.col(by).alias(f"key{side}"),
            F.col("average").alias(f"average{side}"),
            F.col("std_dev").alias(f"std_dev{side}"),
        )
        pairs = pairs.join(renamed, F.col(f"dataset{side}") == F.col(f"key{side}"), "left")
        pairs = pairs.drop(f"key{side}").fillna(0.0, [f"average{side}", f"std_dev{side}"])
    difference = F.abs(F.col("average1") - F.col("average2"))
    return pairs.withColumn("mean_difference", difference)


def compare(data1: DataFrame, data2: DataFrame, value: str) -> DataFrame:
    """Compare two data sets given as two tables; one row."""
    tagged = [
        data.select(F.lit(name).alias("dataset"), F.col(value).alias("value"))
        for name, data in (("first", data1), ("second", data2))
    ]
    pair = data1.sparkSession.range(1).select(
        F.lit("first").alias("dataset1"), F.lit("second").alias("dataset2")
    )
    compared = compare_pairs(tagged[0].unionByName(tagged[1]), "value", "dataset", pair)
    return compared.drop("dataset1", "dataset2")

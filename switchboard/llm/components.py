"""Connected components of a table of links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchboard.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; the root is the smallest node reachable.

    In each round a node takes the smallest label among itself and its neighbours, then the label
    of that label, so distances shrink by doubling. Labels are aggregates, combined before they
    are shuffled; only the number of changed labels reaches the driver.
    """
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = links.select("a", "b").unionByName(turned)
    both = stored(both.distinct(), "links")
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")),
        "labels",
    )
    while True:
        near = both.join(labels, F.col("b") == F.col("node"))
        near = near.select(F.col("a").alias("node"), "root")
        least = near.unionByName(labels).groupBy("node").agg(F.min("root").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("root").alias("next"))
        jumped = least.join(jump, "near").select("node", F.least("near", "next").alias("root"))
        before = labels.withColumnRenamed("root", "old")
        compared = stored(jumped.join(before, "node"), "labels")
        labels = compared.select("node", "root")
        if compared.where("root <> old").isEmpty():
            return labels

"""Lines that many documents share are kept in one document only.

Explode the normalised lines, hash them, count distinct documents per hash, drop the lines over
the threshold except in one document, and put the others together by position.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchboard.llm.common import stored, text_id

# Blanks stripped from the ends of a line before it is compared.
BLANKS = " \t\n\x0b\f\r"


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, n_lines, n_dropped, kept): each row as a struct, and its text without shared lines.

    The key of a line is the line without blanks at its ends and with A-Z lower-cased. Keys of at
    least ``min_chars`` code points that occur in at least ``min_docs`` documents keep their lines
    only in the largest doc_id that holds them; all lines there stay, also repeated ones.

    A null or empty text is one empty line. Rows with the same doc_id are one document for the
    count, and a null doc_id is one document, the smallest. Equal rows give equal results. Any
    other columns are carried in ``doc`` untouched.
    """
    rows = docs.select(
        F.struct("*").alias("doc"),
        "doc_id",
        text_id().alias("text_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    lines = stored(_keyed_lines(rows, min_chars), "lines")
    shared = stored(_shared_keys(lines, min_docs), "shared-lines")
    dropped = (
        lines.join(shared, "key")
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "text_id")
        .agg(F.collect_set("pos").alias("dropped"))  # at most the lines of one text
        .select(F.col("doc_id").alias("its_id"), F.col("text_id").alias("its_text"), "dropped")
    )
    same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("text_id") == F.col("its_text"))
    texts = rows.join(dropped, same, "left").select("doc", "text", "dropped")
    # The generator keeps the lines from being split again for each position.
    parts = F.struct("dropped", F.split("text", "\n").alias("lines"))
    cut = texts.select("doc", "text", F.inline(F.array(parts)))
    everywhere = F.sequence(F.lit(0), F.size("lines") - 1)
    lines_left = F.transform(
        F.array_except(everywhere, "dropped"), lambda i: F.get(F.col("lines"), i)
    )
    return cut.select(
        "doc",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text"))
        .otherwise(F.array_join(lines_left, "\n"))
        .alias("kept"),
    )


def _keyed_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    folded = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    lines = rows.select("doc_id", "text_id", F.posexplode(F.split(folded, "\n")))
    line = F.btrim(F.col("col"), F.lit(BLANKS))
    long_enough = lines.select("doc_id", "text_id", "pos", line.alias("line")).where(
        F.char_length("line") >= min_chars
    )
    return long_enough.select(F.unhex(F.md5("line")).alias("key"), "doc_id", "text_id", "pos")


def _shared_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """(key, keeper). Counted per key and document first, so that no task gets a hot line whole."""
    return (
        lines.groupBy("key", "doc_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("key", "keeper")
    )

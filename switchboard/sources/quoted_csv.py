"""Reader for header-led CSV whose quoted fields may hold line breaks.

The built-in multi-line mode gives each file to one task, so a single huge file would be read by
one core. Here files are always read in splits. A quote opens a field only at the field's start
and is plain text elsewhere in an unquoted field, so a line says for both cases, begun outside and
inside a quoted field, whether it ends inside one. These answers compose: a running sum inside a
split and one row per split tell for every line on which side it begins. Where no line ends
inside a field and all quotes stand where the built-in parser expects them, its line mode is exact
and is used.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from switchboard.operators.skew import stored

# A NUL as the null marker keeps a quoted empty field an empty string.
READ_OPTIONS = {"escape": '"', "nullValue": "\u0000"}

# Where a reader stands after some text: in an unquoted field, at the start of a field, in a
# quoted field, after a quote in a quoted field.
PLAIN, START, QUOTED, CLOSING = range(4)
# Added once text follows a closing quote, which the built-in parser reads in another way.
UNUSUAL = 8


def read_quoted_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """All columns as strings, named by the header, plus ``seq``, the position in file order.

    ``multi_line`` says whether any field spans lines; by default one pass over the text checks.
    A quoted field that is still open at the end of its file is an error that names the place.
    """
    header = spark.read.options(header=True, enforceSchema=False, **READ_OPTIONS).csv(path)
    usual = multi_line is False
    if multi_line is None:
        ends = _state_after(F.col("value"), F.lit(START))
        odd = _lines(spark, path).where((ends == QUOTED) | (ends >= UNUSUAL))
        usual = odd.isEmpty()
    if usual:
        return header.select("*", _position().alias("seq"))

    quoted_names = ["`" + name.replace("`", "``") + "`" for name in header.columns]
    schema = ", ".join(f"{n} string" for n in quoted_names)
    records, all_usual = _records(_lines(spark, path))
    parsed = F.from_csv("record", schema, READ_OPTIONS)
    if all_usual:
        return records.select(parsed.alias("fields"), "seq").select("fields.*", "seq")
    is_usual = _state_after(F.col("record"), F.lit(START)) < UNUSUAL
    by_parser = records.where(is_usual).select(parsed.alias("fields"), "seq")
    by_module = _parsed_by_module(records.where(~is_usual), schema)
    return by_parser.unionByName(by_module).select("fields.*", "seq")


def _position() -> Column:
    """Orders rows by file, split and place in the split, however splits are packed in tasks."""
    metadata = F.col("_metadata")
    line = F.monotonically_increasing_id()
    return _seq(metadata["file_path"], metadata["file_block_start"], line)


def _seq(file: Column, block: Column, line: Column) -> Column:
    """Part files go by their number, which outgrows its padding; others by their path."""
    part = F.regexp_extract(file, r"/part-([0-9]{1,18})[^/]*$", 1)
    number = F.when(part != "", part.cast("long")).otherwise(F.lit(-1).cast("long"))
    return F.struct(
        number.alias("part"), file.alias("file"), block.alias("block"), line.alias("line")
    )


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", _position().alias("seq"))


def _state_after(text: Column, state: Column) -> Column:
    """Where a reader that stands at ``state`` stands after ``text``.

    The text is taken as pieces between quotes: a quote, then the piece after it.
    """
    pieces = F.split(text, '"')

    def passed(state: Column, piece: Column) -> Column:
        at_end = F.when(F.endswith(piece, F.lit(",")), START).otherwise(PLAIN)
        return (
            F.when((state == QUOTED) | (piece == ""), state)
            .when((state == CLOSING) & ~F.startswith(piece, F.lit(",")), at_end + UNUSUAL)
            .otherwise(at_end)
        )

    def quoted(state: Column) -> Column:
        return (
            F.when(state == START, QUOTED)
            .when(state == QUOTED, CLOSING)
            .when(state == CLOSING, QUOTED)
            .otherwise(PLAIN)
        )

    def step(state: Column, piece: Column) -> Column:
        unusual = F.when(state >= UNUSUAL, UNUSUAL).otherwise(0)
        after = passed(quoted(state % UNUSUAL), piece)
        return after % UNUSUAL + F.greatest(unusual, after - after % UNUSUAL)

    first = passed(state, F.get(pieces, F.lit(0)))
    rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    after = F.aggregate(rest, first.cast("int"), lambda s, piece: step(s, piece).cast("int"))
    # Most lines of a long text have no quote: they are one piece.
    return F.when(F.contains(text, F.lit('"')), after).otherwise(passed(state, text).cast("int"))


def _records(lines: DataFrame) -> tuple[DataFrame, bool]:
    """(record, seq) without header records and blank lines, and whether the built-in parser reads
    all of them as the csv module does."""
    lines = lines.select(
        "value",
        F.col("seq.file").alias("file"),
        F.col("seq.block").alias("block"),
        F.col("seq.line").alias("line"),
        _state_after(F.col("value"), F.lit(START)).alias("state_outside"),
        _state_after(F.col("value"), F.lit(QUOTED)).alias("state_inside"),
    )
    for side in ("outside", "inside"):
        state = F.col(f"state_{side}")
        ends_inside = (state % UNUSUAL == QUOTED).cast("int")
        lines = lines.withColumns({f"from_{side}": ends_inside, f"unusual_{side}": state >= UNUSUAL})
    lines = lines.drop("state_outside", "state_inside")
    splits = stored(_splits(lines.drop("value")), "csv-splits")
    _check_closed(splits)
    in_split = Window.partitionBy("file", "block").orderBy("line")
    up_to_here = in_split.rowsBetween(Window.unboundedPreceding, 0)
    begun = splits.select("file", "block", "open", "begun")
    marked = _with_sides(
        lines.join(begun, ["file", "block"]), ["file", "block"], "line", {"inside": F.col("open")}
    ).withColumn("place", F.row_number().over(in_split))
    start = F.last(F.when(F.col("inside") == 0, F.col("line")), ignorenulls=True).over(up_to_here)
    own = F.struct("block", start.alias("line"))
    head = F.when(start.isNotNull(), own).otherwise(F.col("begun"))
    is_header = (F.col("block") == 0) & (F.col("place") == 1)
    is_whole = (F.col("inside") == 0) & (F.col("from_outside") == 0)
    marked = marked.withColumns({"head": head, "is_whole": is_whole}).where(~is_header)
    # Written once: whole records and the lines of longer ones are both read from it.
    marked = stored(marked.select("value", "file", "block", "line", "head", "is_whole"), "csv-lines")

    is_whole = F.col("is_whole")
    whole = marked.where(is_whole & (F.col("value") != "")).select(
        F.col("value").alias("record"),
        _seq(F.col("file"), F.col("block"), F.col("line")).alias("seq"),
    )
    # Only lines of longer records are brought together; a group is the lines of one record.
    in_order = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    stitched = (
        marked.where(~is_whole)
        .groupBy("file", "head")
        .agg(in_order.alias("pieces"))
        .select(
            F.array_join(F.col("pieces.value"), "\n").alias("record"),
            _seq(F.col("file"), F.col("head.block"), F.col("head.line")).alias("seq"),
        )
    )
    return whole.unionByName(stitched), splits.where("unusual").isEmpty()


def _with_sides(
    rows: DataFrame, keys: list[str], order: str, begun: dict[str, Column]
) -> DataFrame:
    """Adds for each name the side on which a row begins, if its group begins on the given side.

    Each row says where it ends if begun outside and inside. Most keep the side, some exchange the
    sides, and some settle it: what came before those does not matter.
    """
    in_order = Window.partitionBy(*keys).orderBy(order)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    up_to_here = in_order.rowsBetween(Window.unboundedPreceding, 0)
    outside, inside = F.col("from_outside"), F.col("from_inside")
    exchange = F.when(outside > inside, 1).otherwise(0)
    rows = rows.withColumn("exchanges", F.sum(exchange).over(up_to_here))
    settles = F.when(outside == inside, F.struct(outside.alias("side"), F.col("exchanges")))
    rows = rows.withColumn("settled", F.last(settles, ignorenulls=True).over(before))
    passed = F.col("exchanges") - exchange
    for name, side in begun.items():
        known = F.col("settled.side") + passed - F.col("settled.exchanges")
        rows = rows.withColumn(
            name, F.when(F.col("settled").isNotNull(), known % 2).otherwise((side + passed) % 2)
        )
    return rows.drop("exchanges", "settled")


def _splits(lines: DataFrame) -> DataFrame:
    """(file, block, open, begun, ...): whether a split starts inside a field, and where the
    record it starts in began.

    A split does not know by itself on which side it starts, so its last record start and its end
    are noted for both cases and chosen once the splits before it are known.
    """
    sides = {"outside": F.lit(0), "inside": F.lit(1)}
    lines = _with_sides(lines, ["file", "block"], "line", sides)

    def after(side: str, what: str = "from") -> Column:
        outside, inside = F.col(f"{what}_outside"), F.col(f"{what}_inside")
        return F.when(F.col(side) == 0, outside).otherwise(inside)

    splits = lines.groupBy("file", "block").agg(
        F.max_by(after("outside"), "line").alias("from_outside"),
        F.max_by(after("inside"), "line").alias("from_inside"),
        F.max(F.when(F.col("outside") == 0, F.col("line"))).alias("start_if_outside"),
        F.max(F.when(F.col("inside") == 0, F.col("line"))).alias("start_if_inside"),
        F.max(after("outside", "unusual")).alias("unusual_if_outside"),
        F.max(after("inside", "unusual")).alias("unusual_if_inside"),
    )
    splits = _with_sides(splits, ["file"], "block", {"open": F.lit(0)})
    is_outside = F.col("open") == 0
    start = F.when(is_outside, F.col("start_if_outside")).otherwise(F.col("start_if_inside"))
    place = F.when(start.isNotNull(), F.struct("block", start.alias("line")))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.when(is_outside, F.col("from_outside")).otherwise(F.col("from_inside"))
    unusual = F.when(is_outside, F.col("unusual_if_outside")).otherwise(F.col("unusual_if_inside"))
    return splits.select(
        "file",
        "block",
        "open",
        F.last(place, ignorenulls=True).over(earlier).alias("begun"),
        place.alias("last_start"),
        ends.alias("ends_inside"),
        unusual.alias("unusual"),
    )


def _check_closed(splits: DataFrame) -> None:
    """A field that is never closed would make the rest of its file one record in one task."""
    ends = splits.groupBy("file").agg(
        F.max_by("ends_inside", "block").alias("open"),
        F.max("last_start.block").alias("block"),
    )
    left_open = ends.where("open = 1").orderBy("file").first()
    if left_open:
        raise ValueError(
            f"{left_open.file}: a quoted field is not closed before the end of the file; its "
            f"record begins in the split at byte {left_open.block}"
        )


def _parsed_by_module(records: DataFrame, schema: str) -> DataFrame:
    """Records with text between a closing quote and the next comma, as the csv module reads
    them."""
    kind = records.select(F.from_csv("record", schema, READ_OPTIONS).alias("fields"), "seq").schema
    names = kind["fields"].dataType.names

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [next(csv.reader([r.as_py()])) for r in batch.column("record")]
            columns = [
                pa.array([row[i] if i < len(row) else None for row in rows], pa.string())
                for i in range(len(names))
            ]
            fields = pa.StructArray.from_arrays(columns, names)
            yield pa.RecordBatch.from_arrays([fields, batch.column("seq")], ["fields", "seq"])

    return records.mapInArrow(parse, kind)

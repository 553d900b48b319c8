r"""Personal data: four fixed kinds, and more found by bootstrapped contextual extraction.

The spans of the fixed kinds are seeds. The words before a seed induce lexical patterns; patterns
and the identifier-like tokens they precede form a graph on which Spark scores patterns by their
instances and instances by their patterns, a fixed number of times. Patterns of high confidence
then find identifiers that the fixed kinds miss. Everything is built-in column functions.

The regular expressions are written so that matching is linear and does not recurse on long runs:
a separator that is only legal between two characters is first replaced by \x01 there, so that
repeated groups become plain character classes, and a match begins at the start of a run or where
the last match ended. Positions and matches are those of the patterns in the comments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from switchboard.llm.common import stored, text_id

# The kinds in their order.
KINDS = ("email", "ip", "card", "phone")

MARK = "\x01"
LOCAL = rf"[A-Za-z0-9._%+{MARK}-]"
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]+"
EMAIL_MARK = r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"
# [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# [0-9]([\x20-]?[0-9])+
CARD = rf"[0-9][0-9{MARK}]++"
CARD_MARK = r"(?<=[0-9])[\x20-](?=[0-9])"
# \+[0-9][\x20().0-9-]+[0-9]
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# A token with a digit or @, or with one of the other forms of @ inside; digit groups that one
# blank separates are one token.
AT = r"(?:\(at\)|\[at\])"
TOKEN = rf"(?<!\S)(?:[^\s0-9@]*+[0-9@]|\S+?{AT}(?=\S))\S*+"
TOKEN_MARK = r"(?<=[0-9)])\x20(?=[0-9(+])"
OPENING, CLOSING = "([{<\"'", ".,;:!?)]}>\"'"
# Code points before a token in which its two context words are looked for.
CONTEXT = 64

# What an identifier of a kind may look like where a pattern, not its form, says what it is.
PLAUSIBLE = {
    "email": r"@|\(at\)|\[at\]",
    "ip": r"^(?=.*:.*:)[0-9A-Fa-f:.]+$",
    "card": r"^[0-9](?=.{11})[0-9 -]*[0-9]$",
    "phone": r"^[(+]?[0-9](?=.{6})[0-9 ()./-]*[0-9]$",
}
PLAUSIBLE_DIGITS = {"email": (0, 64), "ip": (1, 64), "card": (12, 19), "phone": (7, 15)}


def find_personal_data(
    docs: DataFrame, rounds: int = 3, min_confidence: float = 0.8, min_seeds: int = 5
) -> DataFrame:
    """(doc_id, text_id, kind, start, end, base): a row per span; code points, end exclusive.

    ``base`` tells the spans of the fixed kinds from those found by a pattern. A pattern counts if
    its confidence for a kind is at least ``min_confidence`` and it precedes at least
    ``min_seeds`` different seeds. A found span never overlaps a base span.

    A null or empty text has no span. Rows that repeat a doc_id and text give their spans once;
    rows with one doc_id and different texts are told apart by ``text_id``. A null doc_id is an id
    like any other. Other columns are ignored, and an empty table gives no rows.
    """
    rows = docs.select("doc_id", text_id().alias("text_id"), F.col("text").alias("text"))
    plain = F.col("text").rlike("[0-9@]")
    base = stored(_base_spans(rows.where(plain)), "base-spans")
    tokens = stored(_tokens(rows.where(plain | F.col("text").rlike(AT))), "tokens")
    patterns = _strong_patterns(tokens, rounds, min_confidence, min_seeds)
    return base.withColumn("base", F.lit(True)).unionByName(
        _found_spans(tokens, patterns, base).withColumn("base", F.lit(False))
    )


def digest(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Per row of ``docs``: how many base spans of each kind, their hash, and all spans."""
    text = F.concat_ws(":", "kind", "start", "end")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    item = F.struct(order.alias("n"), F.col("start"), F.col("end"), text.alias("text"))
    listed = spans.select("doc_id", "text_id", "kind", "base", item.alias("item"))

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(items), lambda x: x["text"]), ",")

    counts = [F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS]
    per_text = listed.groupBy("doc_id", "text_id").agg(
        *counts,
        joined(F.collect_list(F.when(F.col("base"), F.col("item")))).alias("base_text"),
        joined(F.collect_list("item")).alias("spans"),
    )
    ids = docs.select(F.col("doc_id").alias("id"), text_id().alias("its_text"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("its_text") == F.col("text_id"))
    found = ids.join(per_text, same, "left")
    none = F.lit("")
    return found.select(
        F.col("id").alias("doc_id"),
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.coalesce("base_text", none), 256).alias("base_sha256"),
        F.coalesce("spans", none).alias("spans"),
    )


def _marked(text: Column, places: str) -> Column:
    return F.regexp_replace(F.translate(text, MARK, "\x02"), F.lit(places), F.lit(MARK))


def _matches(text: Column, pattern: str, gap) -> Column:
    """Array of (gap, found): what ``gap`` makes of the text before a match, and the match."""
    gaps = F.transform(F.split(text, pattern, -1), gap)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.arrays_zip(gaps.alias("gap"), found.alias("found"))


def _located(rows: DataFrame, length: Column) -> DataFrame:
    """Adds ``end``, from the lengths of the gaps and matches up to each match of its row."""
    before = Window.partitionBy("doc_id", "text_id", "kind").orderBy("pos")
    return rows.dropDuplicates(["doc_id", "text_id", "kind", "pos"]).withColumn(
        "end", F.sum(length + F.char_length("found")).over(before)
    )


def _base_spans(rows: DataFrame) -> DataFrame:
    text = F.col("text")
    forms = {
        "email": (F.contains(text, F.lit("@")), _marked(text, EMAIL_MARK), EMAIL),
        "ip": (text.rlike(r"[0-9]\.[0-9]"), text, IP),
        "card": (text.rlike(r"[0-9][\x20-]?[0-9]"), _marked(text, CARD_MARK), CARD),
        "phone": (text.rlike(r"\+[0-9]"), text, PHONE),
    }
    kinds = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.when(may, _matches(read, pattern, F.char_length)).alias("hits"),
        )
        for kind, (may, read, pattern) in forms.items()
    ]
    each = rows.select("doc_id", "text_id", F.inline(F.array(*kinds)))
    hits = each.select("doc_id", "text_id", "kind", F.posexplode("hits"))
    hits = hits.select("doc_id", "text_id", "kind", "pos", "col.gap", "col.found")
    placed = _located(hits.where("found is not null"), F.col("gap"))
    start = F.col("end") - F.char_length("found")
    return placed.where(_is_valid(F.col("kind"), F.col("found"))).select(
        "doc_id", "text_id", "kind", start.alias("start"), "end"
    )


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _is_valid(kind: Column, found: Column) -> Column:
    n = F.char_length(_digits(found))
    return (
        F.when(kind == "ip", _is_ip(found))
        .when(kind == "card", n.between(13, 19) & _passes_luhn(found))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def _is_ip(found: Column) -> Column:
    def small(part: Column) -> Column:
        value = F.ltrim(part, F.lit("0"))
        return (F.char_length(value) <= 3) & (F.lpad(value, 3, "0") <= "255")

    return F.forall(F.split(found, r"\."), small)


def _passes_luhn(found: Column) -> Column:
    digits = F.regexp_extract_all(F.reverse(_digits(found)), F.lit("[0-9]"), F.lit(0))

    def worth(digit: Column, place: Column) -> Column:
        value = digit.cast("int")
        return F.when(place % 2 == 0, value).when(value > 4, 2 * value - 9).otherwise(2 * value)

    total = F.aggregate(F.transform(digits, worth), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _tokens(rows: DataFrame) -> DataFrame:
    """Identifier-like tokens: place, text, the kind they are a seed of, and their patterns."""
    read = _marked(F.col("text"), TOKEN_MARK)

    def gap(part: Column) -> Column:
        near = F.lower(F.right(part, F.lit(CONTEXT)))
        return F.struct(F.char_length(part).alias("size"), near.alias("near"))

    each = rows.select(
        "doc_id", "text_id", F.lit("token").alias("kind"), F.posexplode(_matches(read, TOKEN, gap))
    )
    each = each.select("doc_id", "text_id", "kind", "pos", "col.gap", "col.found")
    placed = _located(each.where("found is not null"), F.col("gap.size"))
    opened = F.ltrim("found", F.lit(OPENING))
    words = F.regexp_extract_all(F.col("gap.near"), F.lit(r"\S+"), F.lit(0))
    cleaned = placed.select(
        "doc_id",
        "text_id",
        (F.col("end") - F.char_length(opened)).alias("start"),
        F.translate(F.rtrim(opened, F.lit(CLOSING)), MARK, " ").alias("token"),
        F.reverse(words).alias("words"),
    )
    first, second = F.get("words", F.lit(0)), F.get("words", F.lit(1))
    one = F.when(first.isNotNull(), F.array(first))
    two = F.when(second.isNotNull(), F.array(F.concat_ws(" ", second, first)))
    none = F.array().cast("array<string>")
    return cleaned.where("token <> ''").select(
        "doc_id",
        "text_id",
        "start",
        (F.col("start") + F.char_length("token")).alias("end"),
        "token",
        _seed_kind(F.col("token")).alias("seed"),
        F.concat(F.coalesce(one, none), F.coalesce(two, none)).alias("patterns"),
    )


def _seed_kind(token: Column) -> Column:
    forms = {
        "email": (_marked(token, EMAIL_MARK), EMAIL),
        "ip": (token, IP),
        "card": (_marked(token, CARD_MARK), CARD),
        "phone": (token, PHONE),
    }
    found = F.lit(None).cast("string")
    for kind, (read, pattern) in reversed(forms.items()):
        match = F.regexp_extract(read, pattern, 0)
        is_kind = (match != "") & _is_valid(F.lit(kind), match)
        found = F.when(is_kind, F.lit(kind)).otherwise(found)
    return found


def _strong_patterns(
    tokens: DataFrame, rounds: int, min_confidence: float, min_seeds: int
) -> DataFrame:
    """(pattern, kind) of high confidence, from repeated scoring of the pattern-token graph."""
    edges = stored(
        tokens.select(F.explode("patterns").alias("pattern"), "token", "seed")
        .groupBy("pattern", "token")
        .agg(F.max("seed").alias("seed")),
        "pattern-edges",
    )
    sizes = edges.groupBy("pattern").agg((F.count("*") + 1).alias("size"))
    # Patterns that precede no seed can never gain a score, nor give one.
    seeds = edges.where("seed is not null").select("token", F.col("seed").alias("kind")).distinct()
    scores = seeds.withColumn("score", F.lit(1.0))
    confidence = None
    for _ in range(rounds):
        confidence = stored(
            edges.join(scores, "token")
            .groupBy("pattern", "kind")
            .agg(F.sum("score").alias("total"), F.count_if(F.expr("seed = kind")).alias("seeds"))
            .join(sizes, "pattern")
            .select("pattern", "kind", "seeds", (F.col("total") / F.col("size")).alias("score")),
            "pattern-scores",
        )
        learned = (
            edges.where("seed is null")
            .join(confidence.where("seeds > 0").select("pattern", "kind", "score"), "pattern")
            .groupBy("token", "kind")
            .agg(F.max("score").alias("score"))
        )
        scores = seeds.withColumn("score", F.lit(1.0)).unionByName(learned)
    strong = (F.col("score") >= min_confidence) & (F.col("seeds") >= min_seeds)
    return confidence.where(strong).select("pattern", "kind")


def _found_spans(tokens: DataFrame, patterns: DataFrame, base: DataFrame) -> DataFrame:
    unseen = tokens.where("seed is null").withColumn("pattern", F.explode("patterns"))
    n = F.char_length(_digits(F.col("token")))
    fits = F.lit(False)
    for kind in KINDS:
        low, high = PLAUSIBLE_DIGITS[kind]
        form = F.col("token").rlike(PLAUSIBLE[kind]) & n.between(low, high)
        fits = fits | ((F.col("kind") == kind) & form)
    found = (
        unseen.join(patterns, "pattern")
        .where(fits)
        .groupBy("doc_id", "text_id", "start", "end")
        .agg(F.min("kind").alias("kind"))  # one kind for a span; the first by name
    )
    known = base.select(
        F.col("doc_id").alias("id"),
        F.col("text_id").alias("its_text"),
        F.col("start").alias("from"),
        F.col("end").alias("to"),
    )
    overlaps = (
        F.col("doc_id").eqNullSafe(F.col("id"))
        & (F.col("text_id") == F.col("its_text"))
        & (F.col("start") < F.col("to"))
        & (F.col("from") < F.col("end"))
    )
    return found.join(known, overlaps, "left_anti").select(
        "doc_id", "text_id", "kind", "start", "end"
    )

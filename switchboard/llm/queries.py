"""One registered query per operator, and the SQL text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchboard.llm import (
    brown,
    decontam,
    fill_middle,
    learned_index,
    line_dedup,
    near_dedup,
    packing,
    periodic,
    pii,
    quality,
    suffix_dedup,
    topk,
    toxicity,
)
from switchboard.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


@register
def op1_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score_toxicity(docs, labels, lambda doc_id: ~fold(0, 5, doc_id))
    held_out = fold(0, 5).alias("held_out")
    return found.select("doc_id", held_out, "score", "predicted", "n_tokens", "passages")


@register
def op2_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLE_SQL["op2_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, pos, line,
           translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), shared AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS dropped
    FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), ''))
           AS kept_sha256
FROM marked GROUP BY doc_id
"""


@register
def op3_near_dedup(spark, sf_dir):
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n_words=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL["op3_near_dedup"] = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(words) < 2 THEN words ELSE list_distinct(list_transform(
        range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles
    FROM texts
), sizes AS (
    SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM sets
), entries AS (
    SELECT doc_id, unnest(shingles) AS shingle FROM sets
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), linked AS (
    SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)
), links AS (
    SELECT a, b FROM linked UNION SELECT b, a FROM linked
), reached AS (
    SELECT doc_id, doc_id AS other FROM sizes
    UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT s.doc_id, any_value(s.n) AS n_shingles, min(r.other) AS component_id,
       s.doc_id = min(r.other) AS kept
FROM sizes s JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id
"""


@register
def op4_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"))
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        length.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@register
def op5_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.digest(docs, pii.find_personal_data(docs))


@register
def op6_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@register
def op7_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc.doc_id", F.inline("leaks"))


@register
def op8_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.select("doc_id", "text")
    found = quality.score_quality(rows, labels, lambda doc_id: ~fold(2, 4, doc_id))
    return found.select(
        "doc.doc_id", fold(2, 4, "doc.doc_id").alias("held_out"), "score", "predicted", "n_passages"
    )


@register
def op9_class_model(spark, sf_dir):
    return brown.score_texts(table(spark, sf_dir, "documents"), held_out=fold(0, 10))


@register
def op10_nearest_codes(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.nearest_codes(vectors, is_query=F.col("vec_id") % 100 == 0, k=10)


ORACLE_SQL["op10_nearest_codes"] = """
WITH codes AS (
    SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits
    FROM embeddings
), pairs AS (
    SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
           CAST(list_sum(list_transform(range(1, len(q.bits) + 1),
                lambda i: abs(q.bits[i] - v.bits[i]))) AS BIGINT) AS distance
    FROM codes q, codes v WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank, neighbor_id, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank
    FROM pairs
) WHERE rank <= 10
"""


@register
def op11_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    plant = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = periodic.find_runs(docs, plant=plant)
    # Greatest length, then smallest start, then smallest period.
    ranked = F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]))
    best = F.array_max(ranked)
    found = found.withColumn("best", best)
    start, length, period = -F.col("best.col2"), F.col("best.length"), -F.col("best.col3")
    lines = F.transform(
        "runs",
        lambda r: F.concat(
            F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))),
            F.lit("\n"),
        ),
    )
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLE_SQL["op11_periodic_runs"] = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                                       lambda c: CAST(ord(c) AS BIGINT)),
            lambda crc, c: list_reduce(range(8),
                lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END,
                xor(crc, c)), 4294967295), 4294967295) AS h
    FROM documents
), drawn AS (
    SELECT doc_id, words, len(words) AS n, h % 10 = 0 AND len(words) > 0 AS planted,
        CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a, h // 10 AS g
    FROM texts
), sized AS (
    SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM drawn
), placed AS (
    SELECT doc_id, n, unnest(words) AS own, words, unnest(range(n)) AS i, planted, a, p FROM sized
), word AS (
    SELECT doc_id, n, i, CASE WHEN planted AND i >= a THEN words[1 + a + (i - a) % p]
                              ELSE own END AS w
    FROM placed
), pairs AS (
    SELECT x.doc_id, x.i, y.i - x.i AS period
    FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.w = y.w
    WHERE y.i > x.i AND 2 * (y.i - x.i) <= x.n
), islands AS (
    SELECT doc_id, period, i,
        i - row_number() OVER (PARTITION BY doc_id, period ORDER BY i) AS island
    FROM pairs
), stretches AS (
    SELECT doc_id, min(i) AS start, count(*) + period AS length, period
    FROM islands GROUP BY doc_id, period, island
    HAVING count(*) >= greatest(period, 12 - period)
), runs AS (
    SELECT doc_id, start, length, min(period) AS period
    FROM stretches GROUP BY doc_id, start, length
), listed AS (
    SELECT doc_id, count(*) AS n_runs,
        sha256(string_agg(start || ',' || length || ',' || period || chr(10), ''
                          ORDER BY start, period)) AS runs_sha256,
        first(struct_pack(s := start, l := length, q := period)
              ORDER BY length DESC, start, period) AS best
    FROM runs GROUP BY doc_id
), dropped AS (
    SELECT DISTINCT doc_id, i FROM (
        SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM runs)
), kept AS (
    SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS collapsed
    FROM word ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length,
    best.q AS period, 1000 * best.l // best.q AS exponent_milli,
    coalesce(runs_sha256, sha256('')) AS runs_sha256,
    sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM texts t LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@register
def op12_fill_middle(spark, sf_dir):
    found = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored, 256).alias("restored_sha256"),
    )


ORACLE_SQL["op12_fill_middle"] = r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS digest FROM documents
), drawn AS (
    SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tokens,
        list_transform(range(4),
            lambda i: CAST('0x' || substr(digest, CAST(8 * i + 1 AS INT), 8) AS BIGINT)) AS h
    FROM texts
), cut AS (
    SELECT *, len(tokens) AS n, h[1] % (len(tokens) + 1) AS x, h[2] % (len(tokens) + 1) AS y
    FROM drawn
), parts AS (
    SELECT doc_id, n, text, array_to_string(tokens[: least(x, y)], '') AS prefix,
        array_to_string(tokens[least(x, y) + 1 : greatest(x, y)], '') AS middle,
        array_to_string(tokens[greatest(x, y) + 1 :], '') AS suffix,
        CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h[3] % 100 >= 90 THEN 'plain'
             WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM cut
)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text
        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""


@register
def op13_learned_index(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return learned_index.nearest_vectors(vectors, is_query=F.col("vec_id") % 20 == 0, k=20)

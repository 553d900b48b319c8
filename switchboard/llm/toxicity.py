"""Toxic passages: maximum-scoring segments of token log-odds.

1. Log-odds of tokens between toxic and other labelled documents, with a Dirichlet prior in
   proportion to how often a token occurs at all; a token speaks also through its beginnings.
2. One linear scan per text finds all maximal segments: those that no longer segment outscores
   and that overlap no other.
3. The score of a segment is set against the extreme values expected by chance in a text of that
   many tokens; a text is scored by its strongest and its number of significant segments.

Tables sent to tasks: the ids of a bounded sample of labels, and at most ``MAX_TOKENS`` weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchboard.llm.common import id_and_text, labelled_sample, slices, stored
from switchboard.llm.words import (
    MIX_1,
    NOT_ALPHANUMERIC,
    U64,
    Words,
    mix,
    running_sum,
    span_hash,
    split_words,
)

# A token is looked up whole (0) and by its first bytes.
LEVELS = (0, 6, 5, 4)
LEVEL_SALTS = np.arange(1 + max(LEVELS), dtype=U64) * MIX_1
# Share of the labelled documents that the prior weighs as much as, and least standard score.
PRIOR_SHARE, MIN_Z = 0.1, 3.0
MAX_TOKENS = 20_000
# Score of a token without weight. It is negative, so that scores by chance do not add up.
DRIFT = -0.1
# Least chance of a weighted token in a text that is not toxic.
MIN_CHANCE = 1e-6
SIGNIFICANT = 0.05


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Callable[[str], Column],
    max_rows: int = 20_000,
    threshold: float = 0.5,
) -> DataFrame:
    """(doc_id, score, predicted, n_tokens, passages) per row of ``docs``.

    ``passages`` are the significant segments as (start, end, score, e_value), in code points, end
    exclusive. ``score`` is the probability of label 1, ``predicted`` 1 from ``threshold`` on. The
    weights are learned from at most ``max_rows`` labelled documents whose id ``learn_from``
    accepts; only their texts and labels are read.

    A null or empty text has no token and no passage, and the score of such texts. Equal texts
    get equal scores, and rows are scored each for itself. Without labels of both values every
    score is 0, or 1 if all labels are 1. An empty table gives no rows, and other columns never
    matter.
    """
    sample = stored(labelled_sample(docs, labels, "toxic", learn_from, max_rows), "toxic-sample")
    model = _fit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n_tokens, found = model.passages(part.column("text"))
                score = model.score(n_tokens, found)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "score": pa.array(score),
                        "predicted": pa.array((score >= threshold).astype(np.int32)),
                        "n_tokens": pa.array(n_tokens, pa.int64()),
                        "passages": pa.array(
                            [[p for p in one if p["e_value"] <= SIGNIFICANT] for one in found],
                            PASSAGES,
                        ),
                    }
                )

    return id_and_text(docs).mapInArrow(
        run,
        "doc_id long, score double, predicted int, n_tokens long, "
        "passages array<struct<start: long, end: long, score: double, e_value: double>>",
    )


PASSAGES = pa.list_(
    pa.struct(
        [
            ("start", pa.int64()),
            ("end", pa.int64()),
            ("score", pa.float64()),
            ("e_value", pa.float64()),
        ]
    )
)


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments [start, end) in one pass; the stack holds candidates with the
    running sums before their first and after their last score."""
    stack: list[tuple[int, int, float, float]] = []
    total = 0.0
    for i, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        start, left = i, before
        # A candidate joins the last one that begins lower, unless that one ends as high.
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= total:
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((start, i + 1, left, total))
    return [(start, end, right - left) for start, end, left, right in stack]


def features_of(words: Words) -> np.ndarray:
    """A hash per level (rows) and token (columns)."""
    sums = running_sum(words.data)
    hashes = []
    for level in LEVELS:
        ends = np.minimum(words.ends, words.starts + level) if level else words.ends
        hashes.append(mix(span_hash(sums, words.starts, ends) + LEVEL_SALTS[level]))
    return np.stack(hashes)


@dataclass
class Model:
    """Sorted hashes and their weights, the decay of chance scores, and the final scale."""

    hashes: np.ndarray
    weights: np.ndarray
    decay: float = 1.0
    scale: np.ndarray = field(default_factory=lambda: np.zeros(3))
    constant: float | None = None

    def token_weights(self, words: Words) -> np.ndarray:
        best = np.zeros(len(words.hashes))
        if len(self.hashes):
            for row in features_of(words):
                at = np.minimum(np.searchsorted(self.hashes, row), len(self.hashes) - 1)
                hit = self.hashes[at] == row
                best[hit] = np.maximum(best[hit], self.weights[at[hit]])
        return best

    def passages(self, texts: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
        words = split_words(texts, NOT_ALPHANUMERIC)
        counts = np.diff(words.bounds)
        weights = self.token_weights(words)
        hits = np.flatnonzero(weights)
        found: list[list[dict]] = [[] for _ in range(words.n_rows)]
        rows, first = np.unique(words.rows[hits], return_index=True)
        for row, own in zip(rows.tolist(), np.split(hits, first[1:])):
            found[row] = self._passages_of(words, row, own, weights[own], int(counts[row]))
        return counts, found

    def _passages_of(self, words: Words, row: int, at, weights, n: int) -> list[dict]:
        # Between two weighted tokens the scores only fall: one negative score stands for them.
        gaps = np.diff(at) - 1
        scores = np.empty(2 * len(at) - 1)
        scores[0::2], scores[1::2] = weights, gaps * DRIFT
        begin, end = words.offsets[row], words.offsets[row + 1]
        starts = (words.data[begin:end] & 0xC0) != 0x80  # bytes that begin a code point
        before = np.concatenate([[0], np.cumsum(starts)])
        found = []
        for low, high, score in maximal_segments(scores.tolist()):
            start, stop = words.starts[at[low // 2]], words.ends[at[(high - 1) // 2]]
            e_value = float(min(n * np.exp(-self.decay * score), n))
            span = {"start": int(before[start - begin]), "end": int(before[stop - begin])}
            found.append({**span, "score": score, "e_value": e_value})
        return found

    def evidence(self, n_tokens: np.ndarray, found: list[list[dict]]) -> np.ndarray:
        """Per text: 1, strength of the strongest segment, number of significant segments."""
        x = np.zeros((len(found), 3))
        x[:, 0] = 1
        for i, passages in enumerate(found):
            if passages:
                least = min(p["e_value"] for p in passages)
                x[i, 1] = min(max(-np.log(max(least, 1e-30)), 0), 20) / 10
                x[i, 2] = np.log1p(sum(p["e_value"] <= SIGNIFICANT for p in passages))
        return x

    def score(self, n_tokens: np.ndarray, found: list[list[dict]]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(found), self.constant)
        return 1 / (1 + np.exp(-self.evidence(n_tokens, found) @ self.scale))


def _fit(sample: DataFrame) -> Model:
    counted = sample.groupBy("label").agg(F.count("*").alias("n"))
    sizes = {row.label: row.n for row in counted.collect()}
    empty = Model(np.zeros(0, U64), np.zeros(0))
    if len(sizes) < 2:
        empty.constant = float(min(max(sizes, default=0), 1))
        return empty
    rows = _log_odds(sample, sizes.get(1, 0), sizes.get(0, 0)).collect()
    if rows:
        hashes = np.array([row.token for row in rows], np.int64).view(U64)
        order = np.argsort(hashes)
        empty.hashes, empty.weights = hashes[order], np.array([row.weight for row in rows])[order]
    return _calibrated(sample, empty)


def _log_odds(sample: DataFrame, n_toxic: int, n_other: int) -> DataFrame:
    """(token, weight): log-odds of the tokens that mark toxic documents, counted by document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words = split_words(part.column("text"), NOT_ALPHANUMERIC)
                hashes = features_of(words).ravel()
                rows = np.tile(words.rows, len(LEVELS))
                order = np.lexsort((rows, hashes))
                hashes, rows = hashes[order], rows[order]
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
                hashes, toxic = hashes[new], part.column("label").to_numpy()[rows[new]]
                tokens, at = np.unique(hashes, return_inverse=True)
                with_token = np.bincount(at, minlength=len(tokens))
                of_toxic = np.bincount(at, toxic, len(tokens)).astype(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "token": pa.array(tokens.view(np.int64)),
                        "toxic": pa.array(of_toxic),
                        "other": pa.array(with_token - of_toxic),
                    }
                )

    counts = sample.mapInArrow(run, "token long, toxic long, other long").groupBy("token")
    counts = counts.agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    n = n_toxic + n_other
    prior_size = PRIOR_SHARE * n
    prior = (F.col("toxic") + F.col("other")) * (prior_size / n)
    toxic, other = F.col("toxic") + prior, F.col("other") + prior
    # A token in every document has no odds; half a document keeps them finite.
    weight = F.log(toxic / (n_toxic + prior_size + 0.5 - toxic)) - F.log(
        other / (n_other + prior_size + 0.5 - other)
    )
    z = weight / F.sqrt(1 / toxic + 1 / other)
    scored = counts.select("token", weight.alias("weight"), z.alias("z")).where(F.col("z") >= MIN_Z)
    return scored.orderBy(F.desc("z"), "token").limit(MAX_TOKENS)


def _calibrated(sample: DataFrame, model: Model) -> Model:
    """Fits the decay of chance scores on texts that are not toxic, then the final scale."""

    def count(batches):
        for batch in batches:
            other = batch.filter(pa.array(batch.column("label").to_numpy() == 0))
            for part in slices(other):
                words = split_words(part.column("text"), NOT_ALPHANUMERIC)
                weights = np.round(model.token_weights(words), 1)
                values, n = np.unique(weights, return_counts=True)
                yield pa.RecordBatch.from_pydict({"weight": pa.array(values), "n": pa.array(n)})

    counted = sample.mapInArrow(count, "weight double, n long").groupBy("weight")
    rows = counted.agg(F.sum("n").alias("n")).collect()
    n = {row.weight: row.n for row in rows}
    typical = round(float(np.median(model.weights)), 1) if len(model.weights) else 1.0
    total = max(sum(n.values()), 1)
    chances = {weight: k / total for weight, k in n.items() if weight > 0}
    chances[typical] = max(chances.get(typical, 0), MIN_CHANCE)
    model.decay = _decay(chances)

    def evidence(batches):
        for batch in batches:
            for part in slices(batch):
                x = model.evidence(*model.passages(part.column("text")))
                yield pa.RecordBatch.from_pydict(
                    {"label": part.column("label"), "x": pa.array(x[:, 1]), "k": pa.array(x[:, 2])}
                )

    rows = sample.mapInArrow(evidence, "label int, x double, k double").collect()
    x = np.array([(1, row.x, row.k) for row in rows], float)
    model.scale = _logistic(x, np.array([row.label for row in rows], float))
    return model


def _decay(chances: dict[float, float]) -> float:
    """The positive root of: expected exp(root * score) of a token = 1."""
    rest = 1 - sum(chances.values())

    def excess(root: float) -> float:
        weighted = sum(p * np.exp(root * s) for s, p in chances.items())
        return rest * np.exp(root * DRIFT) + weighted - 1

    low, high = 1e-6, 1e-6
    while excess(high) < 0 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return max(high, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - ridge * beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return beta

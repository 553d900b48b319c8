"""Text quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded; a gated attention, learned from the
labels of whole documents, weighs the passages; the weighted mean of the encodings is scored. The
model is fitted on a bounded sample of labelled documents and sent to all tasks, which score
whole texts where they are read: no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from switchboard.llm.common import labelled_sample, slices, text_bytes
from switchboard.llm.words import split_words

PASSAGE_WORDS = 64
# Byte classes of which a passage has shares.
CLASSES = [
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" \t\x0b\x0c\r",
    b"\n",
    b".",
    b",;:",
    b"!?",
    b"|",
    b"#$%&*@^~",
    b"()[]{}<>/\\=_+",
    b"\"'`-",
    bytes(range(0x80, 0x100)),
]
CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _number, _members in enumerate(CLASSES):
    CLASS_OF[list(_members)] = _number
N_CLASSES = len(CLASSES) + 1
FEATURES = N_CLASSES + 5
HIDDEN, GATE = 16, 8
EPOCHS, RATE, DECAY = 200, 0.02, 1e-4


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Callable[[str], Column],
    max_rows: int = 6_000,
    threshold: float = 0.7,
) -> DataFrame:
    """All columns of ``docs`` as the struct ``doc``, with score, predicted, n_passages and
    top_passage: the number of the passage with the largest weight.

    ``score`` is the probability of label 1, ``predicted`` 1 from ``threshold`` on. The model is
    fitted on at most ``max_rows`` labelled documents whose id ``learn_from`` accepts; only their
    texts and labels are read.

    A null or empty text is one empty passage. Equal texts get equal scores. Where there are no
    labels, or only those of one value, every score is 1 unless all labels are 0. An empty table
    gives no rows, and other columns never matter.
    """
    sample = labelled_sample(docs, labels, "quality", learn_from, max_rows)
    model = fit(*_bags(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                features, bounds = passages(part.column("text"))
                score, weight = model.predict(features, bounds)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc": part.column("doc"),
                        "score": pa.array(score),
                        "predicted": pa.array((score >= threshold).astype(np.int32)),
                        "n_passages": pa.array(np.diff(bounds), pa.int64()),
                        "top_passage": pa.array(_first_largest(weight, bounds), pa.int64()),
                    }
                )

    rows = docs.select(F.struct("*").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    more = T.StructType.fromDDL(
        "score double, predicted int, n_passages long, top_passage long"
    )
    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], *more]))


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and where those of each text begin; every text has one at least."""
    words = split_words(texts)
    raw = text_bytes(texts)[0]
    counts = np.diff(words.bounds)
    per_text = np.maximum(-(-counts // PASSAGE_WORDS), 1)
    bounds = np.concatenate([[0], np.cumsum(per_text)])
    total = int(bounds[-1])
    # A passage begins with a word and goes on to the next one; the first has what stands before.
    number = np.arange(total) - np.repeat(bounds[:-1], per_text)
    first_word = np.repeat(words.bounds[:-1], per_text) + number * PASSAGE_WORDS
    begins = np.where(number == 0, np.repeat(words.offsets[:-1], per_text), 0)
    later = number > 0
    begins[later] = words.starts[first_word[later]]
    sizes = np.diff(np.append(begins, len(raw)))
    passage_of = np.repeat(np.arange(total), sizes)
    shares = np.bincount(passage_of * N_CLASSES + CLASS_OF[raw], minlength=total * N_CLASSES)
    shares = shares.reshape(total, N_CLASSES) / np.maximum(sizes, 1)[:, None]
    n_words = np.minimum(np.repeat(counts, per_text) - number * PASSAGE_WORDS, PASSAGE_WORDS)
    in_text = np.arange(len(words.hashes)) - words.bounds[words.rows]
    passage_of_word = bounds[words.rows] + in_text // PASSAGE_WORDS
    lengths = words.ends - words.starts
    repeats = np.zeros(len(lengths))
    near = np.zeros(len(lengths))
    for back in (1, 2, 3, 4):
        same = np.zeros(len(lengths), bool)
        same[back:] = words.hashes[back:] == words.hashes[:-back]
        same &= in_text >= back
        if back == 1:
            repeats += same
        near = np.maximum(near, same)
    sums = [np.bincount(passage_of_word, x, total) for x in (repeats, near, lengths, lengths > 20)]
    sums = np.stack(sums, 1) / np.maximum(n_words, 1)[:, None]
    sums[:, 2] = np.log1p(sums[:, 2])
    return np.hstack([shares, sums, np.log1p(np.maximum(n_words, 0))[:, None]]), bounds


def _first_largest(weight: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((np.arange(len(weight)), -weight, rows))
    return order[bounds[:-1]] - bounds[:-1]


def _bags(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                features, bounds = passages(part.column("text"))
                cells = [features[a:b].astype("<f4").tobytes() for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_pydict(
                    {"label": part.column("label"), "features": pa.array(cells, pa.binary())}
                )

    rows = sample.mapInArrow(run, "label int, features binary").collect()
    rows.sort(key=lambda row: (row.label, bytes(row.features)))  # the same model each time
    bags = [np.frombuffer(row.features, "<f4").reshape(-1, FEATURES) for row in rows]
    bounds = np.concatenate([[0], np.cumsum([len(bag) for bag in bags])]).astype(np.int64)
    joined = np.concatenate(bags).astype(float) if bags else np.zeros((0, FEATURES))
    return joined, bounds, np.array([row.label for row in rows], float)


class Constant:
    """What is left to say without two kinds of labels."""

    def __init__(self, score: float):
        self.score = score

    def predict(self, features: np.ndarray, bounds: np.ndarray):
        return np.full(len(bounds) - 1, self.score), np.ones(len(features))


class GatedAttention:
    """Encoder, gate and score as small matrices. All sums over a bag are segment sums."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.p = {
            "W": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)),
            "c": np.zeros(HIDDEN),
            "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "w": rng.normal(0, GATE**-0.5, GATE),
            "s": rng.normal(0, HIDDEN**-0.5, HIDDEN),
            "b": np.zeros(1),
        }

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict:
        p, first = self.p, bounds[:-1]
        rows = np.repeat(np.arange(len(first)), np.diff(bounds))
        h = np.tanh(x @ p["W"] + p["c"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, first)[rows])
        a = e / np.add.reduceat(e, first)[rows]
        z = np.add.reduceat(a[:, None] * h, first)
        logit = np.clip(z @ p["s"] + p["b"], -30, 30)
        return {"rows": rows, "h": h, "t": t, "g": g, "a": a, "z": z, "y": 1 / (1 + np.exp(-logit))}

    def gradients(self, x: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> dict:
        p, f, first = self.p, self.forward(x, bounds), bounds[:-1]
        rows, h, t, g, a = (f[k] for k in ("rows", "h", "t", "g", "a"))
        d_logit = (f["y"] - labels) / len(labels)
        d_z = d_logit[:, None] * p["s"]
        d_a = (d_z[rows] * h).sum(1)
        d_e = a * (d_a - np.add.reduceat(a * d_a, first)[rows])
        d_gated = d_e[:, None] * p["w"]
        d_t, d_g = d_gated * g * (1 - t**2), d_gated * t * g * (1 - g)
        d_h = a[:, None] * d_z[rows] + d_t @ p["V"].T + d_g @ p["U"].T
        d_in = d_h * (1 - h**2)
        return {
            "W": x.T @ d_in,
            "c": d_in.sum(0),
            "V": h.T @ d_t,
            "U": h.T @ d_g,
            "w": (t * g).T @ d_e,
            "s": f["z"].T @ d_logit,
            "b": np.array([d_logit.sum()]),
        }

    def predict(self, features: np.ndarray, bounds: np.ndarray):
        found = self.forward((features - self.mean) / self.scale, bounds)
        return found["y"], found["a"]


def fit(features: np.ndarray, bounds: np.ndarray, labels: np.ndarray):
    if len(labels) == 0 or labels.min() == labels.max():
        return Constant(1.0 if len(labels) == 0 else float(labels[0]))
    model = GatedAttention(features.mean(0), features.std(0) + 1e-3)
    x = (features - model.mean) / model.scale
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, EPOCHS + 1):
        for k, d in model.gradients(x, bounds, labels).items():
            d = d + DECAY * model.p[k]
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            model.p[k] = model.p[k] - RATE * move
    return model

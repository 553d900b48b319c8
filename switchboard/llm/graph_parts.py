"""Balanced parts of a neighbour graph, and small classifiers that learn them from vectors.

Works on a bounded sample held as arrays; ``learned_index`` applies the result to all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HIDDEN, EPOCHS, BATCH, RATE = 128, 24, 256, 4e-3
SMOOTHING, SWAPS = 24, 12


def nearest(queries: np.ndarray, base: np.ndarray, k: int, own: bool = False) -> np.ndarray:
    """The ``k`` rows of ``base`` with the largest inner products; ``own`` says that query ``i``
    is row ``i``, which then is left out."""
    k = min(k, len(base) - own)
    found = np.empty((len(queries), k), np.int64)
    for start in range(0, len(queries), 512):
        part = slice(start, min(start + 512, len(queries)))
        scores = queries[part] @ base.T
        if own:
            scores[np.arange(len(scores)), np.arange(part.start, part.stop)] = -np.inf
        found[part] = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k else 0
    return found


def balanced_parts(neighbours: np.ndarray, n_parts: int) -> np.ndarray:
    """Parts of equal size (up to one node) with few edges between them, by recursive bisection;
    ``n_parts`` is a power of two."""
    n, degree = neighbours.shape
    one, two = np.repeat(np.arange(n), degree), neighbours.ravel()
    edges = np.concatenate([[one, two], [two, one]], axis=1)
    rng = np.random.default_rng(0)
    parts = np.zeros(n, np.int64)
    done = 1
    while done < n_parts:
        inside = parts[edges[0]] == parts[edges[1]]
        upper = np.zeros(n, bool)
        for part in range(done):
            nodes = np.flatnonzero(parts == part)
            local = np.full(n, -1)
            local[nodes] = np.arange(len(nodes))
            own = edges[:, inside & (parts[edges[0]] == part)]
            upper[nodes] = _bisect(local[own], len(nodes), rng)
        parts = parts * 2 + upper
        done *= 2
    return parts


def _bisect(edges: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Half of the nodes: split at the median of a smooth function on the graph, then swapped in
    pairs as long as edges between the halves become fewer."""
    one, two = edges
    degree = np.maximum(np.bincount(one, minlength=n), 1)
    value = rng.standard_normal(n)
    for _ in range(SMOOTHING):
        value = value / 2 + np.bincount(one, value[two], n) / degree / 2
        value -= np.average(value, weights=degree)
        value /= np.abs(value).max() or 1.0
    upper = np.zeros(n, bool)
    upper[np.argsort(value, kind="stable")[n // 2 :]] = True
    best, fewest = upper, np.count_nonzero(upper[one] != upper[two])
    for turn in range(SWAPS):
        across = upper[one] != upper[two]
        gain = np.bincount(one, np.where(across, 1.0, -1.0), n)
        halves = [np.flatnonzero(side)[np.argsort(-gain[side], kind="stable")] for side in (upper, ~upper)]
        pairs = min(map(len, halves))
        better = np.count_nonzero(gain[halves[0][:pairs]] + gain[halves[1][:pairs]] > 0)
        # Neighbours that both move undo each other's gain, so not all move at once.
        moved = max(1, better // (2 + turn)) if better else 0
        if not moved:
            break
        upper = upper.copy()
        upper[halves[0][:moved]], upper[halves[1][:moved]] = False, True
        cut = np.count_nonzero(upper[one] != upper[two])
        if cut < fewest:
            best, fewest = upper, cut
    return best


@dataclass
class Classifier:
    """One hidden layer between a vector and the probabilities of the parts."""

    hidden: np.ndarray
    hidden_bias: np.ndarray
    output: np.ndarray
    output_bias: np.ndarray

    def _layers(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(vectors @ self.hidden + self.hidden_bias, 0)
        logits = hidden @ self.output + self.output_bias
        weights = np.exp(logits - logits.max(axis=1, keepdims=True))
        return hidden, weights / weights.sum(axis=1, keepdims=True)

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        return self._layers(vectors.astype(np.float32))[1]


def train(vectors: np.ndarray, targets: np.ndarray, seed: int = 0) -> Classifier:
    """Least cross entropy to the rows of ``targets``, by Adam on shuffled batches."""
    rng = np.random.default_rng(seed)
    vectors, targets = vectors.astype(np.float32), targets.astype(np.float32)
    (n, width), n_parts = vectors.shape, targets.shape[1]
    scale = np.sqrt((vectors**2).sum(axis=1).mean()) or 1.0
    model = Classifier(
        (rng.standard_normal((width, HIDDEN)) * np.sqrt(2) / scale).astype(np.float32),
        np.zeros(HIDDEN, np.float32),
        (rng.standard_normal((HIDDEN, n_parts)) / np.sqrt(HIDDEN)).astype(np.float32),
        np.zeros(n_parts, np.float32),
    )
    weights = [model.hidden, model.hidden_bias, model.output, model.output_bias]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    step, steps = 0, EPOCHS * -(-n // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for start in range(0, n, BATCH):
            rows = order[start : start + BATCH]
            hidden, chances = model._layers(vectors[rows])
            error = (chances - targets[rows]) / len(rows)
            back = (error @ model.output.T) * (hidden > 0)
            slopes = [vectors[rows].T @ back, back.sum(0), hidden.T @ error, error.sum(0)]
            step += 1
            rate = RATE * (1 - (step - 1) / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for weight, slope, mean, square in zip(weights, slopes, first, second):
                mean += 0.1 * (slope - mean)
                square += 0.001 * (slope**2 - square)
                weight -= (rate * mean / (np.sqrt(square) + 1e-8)).astype(np.float32)
    return model


@dataclass
class Parts:
    """Which part a row is kept in, and which parts a query has to ask."""

    keeper: Classifier
    router: Classifier
    # A query asks its most probable parts until those before sum to more than this.
    enough: float

    def keep(self, vectors: np.ndarray) -> np.ndarray:
        return self.keeper.probabilities(vectors).argmax(axis=1)

    def ask(self, queries: np.ndarray, sizes: np.ndarray | None = None, least: int = 0) -> np.ndarray:
        """(query, part) as a table of booleans; with the ``sizes`` of the parts a query goes on
        until those it asks have ``least`` rows."""
        chances = self.router.probabilities(directions(queries))
        asked = _sum_before(chances, chances) <= self.enough
        if sizes is not None:
            asked |= _sum_before(chances, np.broadcast_to(sizes, chances.shape)) < least
        return asked


def directions(vectors: np.ndarray) -> np.ndarray:
    """The length of a query changes no order of its neighbours."""
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def _sum_before(chances: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each part, the sum of the values of the more probable parts."""
    order = np.argsort(-chances, axis=1, kind="stable")
    sums = np.cumsum(np.take_along_axis(values, order, 1).astype(np.float64), axis=1)
    before = np.zeros_like(sums)
    before[:, 1:] = sums[:, :-1]
    result = np.empty_like(before)
    np.put_along_axis(result, order, before, 1)
    return result


def fit(sample: np.ndarray, n_parts: int, k: int, recall: float, degree: int = 10) -> Parts:
    """Learn parts from one half of the sample and set ``enough`` on the other half.

    The first half's neighbour graph is cut into balanced parts, which the keeper learns. The
    router learns in which parts the keeper has the neighbours of a vector. On the second half,
    which neither has seen, ``enough`` is the least value with which queries reach ``recall`` of
    their ``k`` nearest rows; neighbours are farther in a sample than in the whole table, so this
    is on the safe side.
    """
    half = len(sample) // 2
    seen, unseen = sample[:half], sample[half:]
    graph = nearest(seen, seen, degree, own=True)
    parts = balanced_parts(graph, n_parts)
    # A part is learned from a row and its neighbours in the graph.
    targets = _shares(parts[np.column_stack([np.arange(half)] * degree + [graph])], n_parts)
    keeper = train(seen, targets)
    kept = keeper.probabilities(seen).argmax(axis=1)
    near = nearest(directions(seen), seen, 2 * degree, own=True)
    router = train(directions(seen), _shares(kept[near], n_parts), seed=1)

    asked = directions(unseen[: max(1, min(1024, len(unseen) // 2))])
    truth = nearest(asked, unseen, k, own=True)
    kept = keeper.probabilities(unseen).argmax(axis=1)
    chances = router.probabilities(asked)
    before = _sum_before(chances, chances)
    needed = np.take_along_axis(before, kept[truth], 1).ravel()
    enough = float(np.quantile(needed, recall, method="higher")) if needed.size else 1.0
    return Parts(keeper, router, enough)


def _shares(parts: np.ndarray, n_parts: int) -> np.ndarray:
    """How often each part is among the parts of a row, summing to one."""
    counts = np.zeros((len(parts), n_parts))
    np.add.at(counts, (np.arange(len(parts))[:, None], parts), 1)
    return counts / counts.sum(axis=1, keepdims=True)

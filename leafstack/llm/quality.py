"""A quality classifier: histogram gradient-boosted trees over document statistics.

One pass over the texts gives the statistics, a few numbers per document. A
bounded sample of labelled rows is fitted on the driver: features are cut into
at most 64 bins, trees grow level by level from gradient histograms, and the
trees are kept as flat arrays. Scoring walks all trees for a whole batch with
numpy, from the statistics alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import settled
from .arrow import bodies, slices
from .common import table
from .sampling import held_out, labelled, sample
from .texts import pieces

MOST_PER_CLASS = 10_000
BINS, TREES, DEPTH, RATE, PENALTY = 64, 80, 4, 0.15, 1.0
PIECE_BYTES = 1 << 20
SLICE_BYTES = 4 << 20

CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 10, 11, 12, 13, 32),
    "high": range(128, 256), "stop": b".,;:", "end": b"!?", "quote": b"\"'`", "bracket": b"()[]{}<>", "bar": b"|",
    "symbol": b"#$%&*@^~_+=\\/", "control": [*range(9), *range(14, 32), 127], "line": b"\n",
}
NAMES = [*CLASSES, *(
    "log_words log_bytes word_length long_words distinct_words top_word repeated_next distinct_triples "
    "distinct_lines line_words short_lines most_of_line capital_words letter_words".split()
)]
_MEMBERS = np.zeros((256, len(CLASSES)))
for _k, _bytes in enumerate(CLASSES.values()):
    _MEMBERS[list(_bytes), _k] = 1


def _statistics(body: bytes) -> np.ndarray:
    counts = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    shares = counts @ _MEMBERS / max(1, len(body))
    words = body.split()
    n = len(words)
    lines = [x for x in body.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, n)
    often = Counter(words).most_common(1)[0][1] if n else 0
    line_counts = Counter(lines)
    top_line = max((c * len(x) for x, c in line_counts.items() if c > 1), default=0)
    return np.concatenate([shares, [
        np.log1p(n), np.log1p(len(body)), sizes.mean() if n else 0, (sizes > 15).mean() if n else 0,
        len(set(words)) / n if n else 0, often / n if n else 0,
        sum(map(bytes.__eq__, words, words[1:])) / n if n else 0,
        len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1,
        len(line_counts) / len(lines) if lines else 0, n / len(lines) if lines else 0,
        sum(len(x) < 20 for x in lines) / len(lines) if lines else 0, top_line / max(1, len(body)),
        sum(map(bytes.istitle, words)) / n if n else 0, sum(map(bytes.isalpha, words)) / n if n else 0,
    ]])


def statistics(body: bytes) -> np.ndarray:
    """The numbers named by ``NAMES``; a text over 1 MB has the mean of its pieces, by their bytes."""
    parts = list(pieces(body, PIECE_BYTES))
    if len(parts) == 1:
        return _statistics(body)
    return np.average([_statistics(p) for p in parts], axis=0, weights=[len(p) for p in parts])


class Trees:
    """Boosted trees as arrays: split features and values in heap order, and the leaves' values."""

    def __init__(self, base: float, features: np.ndarray, values: np.ndarray, leaves: np.ndarray):
        self.base, self.features, self.values, self.leaves = base, features, values, leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1])) if len(self.leaves) else 0
        for features, values, leaves in zip(self.features, self.values, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, features[node]] > values[node])
            total += leaves[node - (leaves.size - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(
    x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None,
    trees=TREES, depth=DEPTH, bins=BINS, rate=RATE, penalty=PENALTY,
) -> Trees:
    """Fit logistic loss, a row counting as often as its weight says; without both classes the score is constant (0.5 without rows)."""
    w = np.ones(len(y)) if weights is None else weights
    p = (w @ y + 0.5) / (w.sum() + 1.0)
    base, n_features, inner = float(np.log(p / (1 - p))), x.shape[1], (1 << depth) - 1
    empty = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(np.unique(y)) < 2:
        return empty
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(n_features)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    upper = np.full((n_features, bins), np.inf)
    for f, e in enumerate(edges):
        upper[f, :len(e)] = e
    cells = binned + np.arange(n_features) * bins
    total = np.full(len(y), base)
    kept = ([], [], [])
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-total))
        grad, hess = w * (prob - y), w * prob * (1 - prob)
        node = np.zeros(len(y), np.int64)
        features, values = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            index = ((node - first)[:, None] * (n_features * bins) + cells).ravel()
            size = width * n_features * bins
            g = np.bincount(index, np.repeat(grad, n_features), size).reshape(width, n_features, bins).cumsum(2)
            h = np.bincount(index, np.repeat(hess, n_features), size).reshape(width, n_features, bins).cumsum(2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + penalty) + (all_g - g)**2 / (all_h - h + penalty) - all_g**2 / (all_h + penalty)
            gain = np.where(np.isfinite(upper)[None] & (h > 1) & (all_h - h > 1), gain, 0).reshape(width, -1)
            best = gain.argmax(1)
            split = gain[np.arange(width), best] > 1e-6
            features[first:first + width] = best // bins
            values[first:first + width] = np.where(split, upper.ravel()[best], np.inf)
            f = features[node]
            node = 2 * node + 1 + (x[np.arange(len(y)), f] > values[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + penalty)
        total += value[leaf]
        for store, array in zip(kept, (features, values, value)):
            store.append(array)
    return Trees(base, *map(np.array, kept))


def document_statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, features`` of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", SLICE_BYTES):
            rows = [statistics(b).astype(np.float32) for b in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, pa.list_(pa.float32()))], ["doc_id", "features"]
            )

    rows = bodies(documents, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(read, f"doc_id {kind}, features array<float>")


def class_weights(allowed: DataFrame, chosen: DataFrame, y: np.ndarray) -> np.ndarray:
    """For each label of ``y`` the inverse of the rate its class was sampled at; their mean is 1."""
    totals, drawn = ({r["label"]: r["count"] for r in rows.groupBy("label").count().collect()} for rows in (allowed, chosen))
    rates = np.array([totals.get(k, 0) / max(1, drawn.get(k, 0)) for k in (0, 1)])
    weights = rates[y.astype(np.int64)]
    return weights / weights.mean() if len(weights) else weights


def quality_scores(
    documents: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held: int = 1,
    id_col: str = "doc_id", text_col: str = "text", most_per_class: int = MOST_PER_CLASS,
) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Learns from at most about ``most_per_class`` labelled rows of each class
    whose ids are not held out; weights give the classes back the shares they
    have among all such rows, so scores do not depend on the bound. NULL and empty texts are scored by their
    (zero) statistics. NULL ids are scored, never learned from and not held
    out. Without labels of both classes the score is constant. An empty table
    gives no rows; other columns are ignored.
    """
    features = settled(document_statistics(documents, id_col, text_col))
    allowed = labelled(labels, label, ~held_out(modulus, held))
    chosen = sample(allowed, "label", most_per_class)
    rows = chosen.join(features, "doc_id").select("label", "features").toArrow()
    x = np.array(rows.column("features").to_pylist(), np.float64).reshape(-1, len(NAMES))
    y = rows.column("label").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))
    model = fit(x[order], y[order], class_weights(allowed, chosen, y[order]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            s = model.score(x.astype(np.float64))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)),
            ], ["doc_id", "held_out", "score", "predicted"])

    kind = features.schema["doc_id"].dataType.simpleString()
    return features.select("doc_id", held_out(modulus, held).alias("held_out"), "features").mapInArrow(
        score, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op10_quality": op10_quality}
ORACLES: dict[str, str] = {}

"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is the embedding of the word (words of the training sample that
are seen often enough; all others share one) beside the mean embedding of its
character trigrams, hashed. Overlapping windows of words run through a
forward and a backward GRU; attention pools the states of a window into one
logit. All windows of a text are scored, each word being in two of them; the
text's score is a calibrated function of its highest logit.

The network is trained in numpy on the driver, on a bounded sample of
labelled documents. Labels are for whole documents, so a toxic document teaches
by its most telling windows, found by the words' document odds. The input part
of the gates is computed once per distinct word of a batch, so a step of the
network costs one small product for thousands of windows at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .arrow import bodies, slices
from .common import table
from .sampling import held_out, labelled, sample
from .texts import pieces

MOST_PER_CLASS = 1500
DOC_BYTES = 20_000
WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, STATES = 8, 8, 8
CHAR_BUCKETS = 1 << 12
LEAST_DOCS = 5
CLEAN_PER_TOXIC = 4
STEPS, BATCH, RATE = 180, 256, 0.01
SLICE_BYTES = 2 << 20
CACHED_WORDS = 200_000
BATCH_WINDOWS = 2048
WORD = re.compile(rb"[a-z\x80-\xff]+")


def words_of(body: bytes) -> list[bytes]:
    """Runs of Latin letters, in lower case, and of bytes beyond ASCII."""
    return WORD.findall(body.lower())


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values by row."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    order = np.argsort(rows, kind="stable")
    placed = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], placed[1:] != placed[:-1]]))
    out[placed[starts]] = np.add.reduceat(values[order], starts)
    return out


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all marked words in a row, and where each word's begin."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    flat = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.int64)
    codes = np.zeros(len(flat), np.int64)
    codes[:-2] = flat[:-2] * 65599 + flat[1:-1] * 257 + flat[2:]
    codes = (codes * 0x9E3779B1 >> 8) % CHAR_BUCKETS
    keep = np.ones(len(flat), bool)
    stops = np.cumsum(sizes)
    keep[stops - 1] = keep[stops - 2] = False
    return codes[keep], np.concatenate([[0], np.cumsum(sizes - 2)[:-1]])


def windows(n: int) -> np.ndarray:
    """Starts of the windows over ``n`` words: every ``STRIDE`` words, the last one ending with the text."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name, with a vocabulary of words; all arrays are float32."""

    def __init__(self, vocab: dict[bytes, int], odds: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.vocab = vocab
        wide = WORD_DIM + CHAR_DIM

        def draw(*shape, scale=0.1):
            return rng.normal(0, scale, shape).astype(np.float32)

        self.p = {
            "words": draw(len(vocab) + 1, WORD_DIM), "chars": draw(CHAR_BUCKETS, CHAR_DIM),
            "attend": draw(2 * STATES), "out": draw(2 * STATES), "bias": np.zeros(1, np.float32),
        }
        self.p["words"][:len(vocab), 0] += np.clip(odds, -2, 4) / 4
        for d in "fb":
            self.p |= {
                f"w{d}": draw(wide, 3 * STATES, scale=wide**-0.5), f"u{d}": draw(STATES, 3 * STATES, scale=STATES**-0.5),
                f"c{d}": np.zeros(3 * STATES, np.float32),
            }

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Embedding of each word beside the mean of its characters'."""
        ids = np.fromiter((self.vocab.get(w, len(self.vocab)) for w in words), np.int64, len(words))
        codes, starts = trigrams(words)
        sums = np.add.reduceat(self.p["chars"][codes], starts)
        sizes = np.diff(np.append(starts, len(codes)))
        return np.hstack([self.p["words"][ids], sums / sizes[:, None]])

    def gates(self, inputs: np.ndarray) -> np.ndarray:
        """The input part of both directions' gates, and a last row for padding."""
        both = np.hstack([inputs @ self.p["wf"] + self.p["cf"], inputs @ self.p["wb"] + self.p["cb"]])
        return np.vstack([both, np.zeros((1, both.shape[1]))]).astype(np.float32)

    def _run(self, x: np.ndarray, live: np.ndarray, u: np.ndarray, steps, keep: list | None) -> np.ndarray:
        """States ``[place, window, state]`` of one direction; padding keeps the state."""
        h = np.zeros((x.shape[1], STATES), np.float32)
        out = np.zeros((x.shape[0], x.shape[1], STATES), np.float32)
        for t in steps:
            gate = h @ u
            zr = _sigmoid(x[t, :, :2 * STATES] + gate[:, :2 * STATES])
            z, r = zr[:, :STATES], zr[:, STATES:]
            n = np.tanh(x[t, :, 2 * STATES:] + r * gate[:, 2 * STATES:])
            new = n + z * (h - n)
            if keep is not None:
                keep.append((t, h, z, r, n, gate[:, 2 * STATES:]))
            h = new if live[t].all() else np.where(live[t][:, None], new, h)
            out[t] = h
        return out

    def logits(self, gates: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """A logit per window; ``ids`` ``[place, window]`` are rows of ``gates``, the last one for padding."""
        return self._forward(gates, ids)[0]

    def _forward(self, gates: np.ndarray, ids: np.ndarray, keep: bool = False):
        live, x = ids < len(gates) - 1, gates[ids]
        kept = ([], []) if keep else (None, None)
        places = range(len(ids))
        forward = self._run(x[:, :, :3 * STATES], live, self.p["uf"], places, kept[0])
        backward = self._run(x[:, :, 3 * STATES:], live, self.p["ub"], reversed(places), kept[1])
        states = np.concatenate([forward, backward], axis=2)
        weight = np.where(live, np.tanh(states) @ self.p["attend"], -30)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (states * weight[:, :, None]).sum(axis=0)
        return pooled @ self.p["out"] + self.p["bias"], states, weight, pooled, live, kept

    def gradients(self, inputs: np.ndarray, ids: np.ndarray, y: np.ndarray):
        """Gradients of the mean logistic loss, and of the inputs of the distinct words."""
        gates = self.gates(inputs)
        logits, states, weight, pooled, live, kept = self._forward(gates, ids, keep=True)
        d_logit = ((_sigmoid(logits) - y) / len(y)).astype(np.float32)
        g = {"bias": np.array([d_logit.sum()]), "out": pooled.T @ d_logit}
        d_pooled = d_logit[:, None] * self.p["out"]
        d_states = weight[:, :, None] * d_pooled[None]
        d_weight = (states * d_pooled[None]).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0)) * live
        squashed = np.tanh(states)
        g["attend"] = np.einsum("tns,tn->s", squashed, d_score)
        d_states += d_score[:, :, None] * self.p["attend"] * (1 - squashed**2)
        d_inner = np.zeros((*ids.shape, 6 * STATES), np.float32)
        for k, d in enumerate("fb"):
            u, d_u = self.p[f"u{d}"], np.zeros_like(self.p[f"u{d}"])
            part = d_states[:, :, k * STATES:(k + 1) * STATES]
            d_h = np.zeros((ids.shape[1], STATES), np.float32)
            for t, h, z, r, n, inner in reversed(kept[k]):
                d_h = d_h + part[t]
                d_new = np.where(live[t][:, None], d_h, 0)
                d_n = d_new * (1 - z) * (1 - n**2)
                d_z = d_new * (h - n) * z * (1 - z)
                d_r = d_n * inner * r * (1 - r)
                d_in = np.hstack([d_z, d_r, d_n])
                d_gate = np.hstack([d_z, d_r, d_n * r])
                d_u += h.T @ d_gate
                d_h = np.where(live[t][:, None], d_new * z, d_h) + d_gate @ u.T
                d_inner[t, :, k * 3 * STATES:(k + 1) * 3 * STATES] = d_in
            g[f"u{d}"] = d_u
        d_gates = _scatter(ids.ravel(), d_inner.reshape(-1, 6 * STATES), len(gates))
        d_inputs = np.zeros_like(inputs)
        for k, d in enumerate("fb"):
            part = d_gates[:-1, k * 3 * STATES:(k + 1) * 3 * STATES]
            g[f"w{d}"], g[f"c{d}"] = inputs.T @ part, part.sum(axis=0)
            d_inputs += part @ self.p[f"w{d}"].T
        return g, d_inputs


def _train(net: Network, items: list[list[bytes]], y: np.ndarray, steps: int, seed: int = 9) -> None:
    """Adam on mini-batches of windows (lists of words), for at least ``steps`` of them."""
    rng, step = np.random.default_rng(seed), 0
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    while step < steps:
        order = rng.permutation(len(items))
        for start in range(0, len(items), BATCH):
            part = order[start:start + BATCH]
            words = sorted({w for i in part for w in items[i]})
            place = {w: k for k, w in enumerate(words)}
            ids = np.full((WINDOW, len(part)), len(words), np.int64)
            for k, i in enumerate(part):
                ids[:len(items[i]), k] = [place[w] for w in items[i]]
            g, d_inputs = net.gradients(net.inputs(words), ids, y[part].astype(np.float32))
            rows = np.fromiter((net.vocab.get(w, len(net.vocab)) for w in words), np.int64, len(words))
            g["words"] = _scatter(rows, d_inputs[:, :WORD_DIM], len(net.p["words"]))
            codes, starts = trigrams(words)
            sizes = np.diff(np.append(starts, len(codes)))
            each = np.repeat(d_inputs[:, WORD_DIM:] / sizes[:, None], sizes, axis=0)
            g["chars"] = _scatter(codes, each, CHAR_BUCKETS)
            step += 1
            for k, v in g.items():
                mean[k] += 0.1 * (v - mean[k])
                square[k] += 0.001 * (v * v - square[k])
                rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                net.p[k] -= (rate * mean[k] / (np.sqrt(square[k]) + 1e-7)).astype(np.float32)


class Scorer:
    """Highest window logit of texts; keeps the gate inputs of the words it has seen."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.rows, self.gates = {}, self.net.gates(np.zeros((0, WORD_DIM + CHAR_DIM), np.float32))

    def _learn(self, words: list[bytes]) -> None:
        base = len(self.gates) - 1
        self.gates = np.vstack([self.gates[:-1], self.net.gates(self.net.inputs(words))])
        self.rows.update(zip(words, range(base, base + len(words))))

    def highest(self, texts: list[bytes]) -> np.ndarray:
        """The highest logit of each text, -inf for texts without words.

        A text over ``SLICE_BYTES`` is read in pieces; the words at a seam are read with both.
        """
        out = np.full(len(texts), -np.inf)
        if len(self.rows) > CACHED_WORDS:
            self.clear()
        owners, parts = [], []
        for k, body in enumerate(texts):
            rest: list[bytes] = []
            for part in pieces(body, SLICE_BYTES):
                words = rest + words_of(part)
                if words:
                    owners.append(k)
                    parts.append(words)
                rest = words[-STRIDE:]
        new = set()
        for words in parts:
            new.update(words)
        new.difference_update(self.rows)
        if new:
            self._learn(sorted(new))
        if not parts:
            return out
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        rows = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(parts)), np.int32, int(sizes.sum()))
        ends = np.cumsum(sizes)
        starts = [windows(n) for n in sizes.tolist()]
        counts = np.fromiter(map(len, starts), np.int64, len(starts))
        start = np.concatenate(starts) + np.repeat(ends - sizes, counts)
        stop, owner = np.repeat(ends, counts), np.repeat(np.array(owners), counts)
        for a in range(0, len(start), BATCH_WINDOWS):
            place = start[None, a:a + BATCH_WINDOWS] + np.arange(WINDOW)[:, None]
            inside = place < stop[None, a:a + BATCH_WINDOWS]
            ids = np.where(inside, rows[np.minimum(place, len(rows) - 1)], len(self.gates) - 1)
            np.maximum.at(out, owner[a:a + BATCH_WINDOWS], self.net.logits(self.gates, ids))
        return out


class Model:
    """A network and the line that turns a text's highest logit into its score."""

    def __init__(self, net: Network | None, slope: float, shift: float, base: float):
        self.net, self.slope, self.shift, self.base = net, slope, shift, base

    def scores(self, highest: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.full(len(highest), self.base)
        return np.where(np.isinf(highest), self.base, 1 / (1 + np.exp(-np.clip(self.slope * highest + self.shift, -30, 30))))


def fit(texts: list[bytes], y: np.ndarray, weights: tuple[float, float] = (1.0, 1.0), steps: int = STEPS) -> Model:
    """Train on labelled texts; ``weights`` undo the sampling of the classes (0, 1) in the calibration."""
    shares = [weights[0] * float((y == 0).sum()), weights[1] * float((y == 1).sum())]
    base = (shares[1] + 0.5) / (sum(shares) + 1.0)
    base = min(base, 0.49) if shares[1] <= shares[0] else base
    cut = [words_of(t) for t in texts]
    if len(np.unique(y)) < 2:
        return Model(None, 0.0, 0.0, base)
    docs, toxic = Counter(), Counter()
    for words, label in zip(cut, y):
        docs.update(set(words))
        if label:
            toxic.update(set(words))
    often = sorted(w for w, n in docs.items() if n >= LEAST_DOCS)
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    odds = np.array([np.log((toxic[w] + 0.5) / (n1 + 1)) - np.log((docs[w] - toxic[w] + 0.5) / (n0 + 1)) for w in often], np.float32)
    # a word must be clearly more frequent in toxic documents to mark a window
    telling = {w: o for w, o in zip(often, odds) if o > 2 and toxic[w] >= max(LEAST_DOCS, n1 / 100)}
    rng, items, marks = np.random.default_rng(3), [], []
    for words, label in zip(cut, y):
        if not words:
            continue
        starts = windows(len(words))
        if label:
            weight = np.array([sum(telling.get(w, 0) for w in words[s:s + WINDOW]) for s in starts])
            chosen = np.argsort(-weight, kind="stable")[:3]
            chosen = [starts[i] for i in chosen if weight[i] > 0] if telling else starts[:3]
        else:
            chosen = rng.choice(starts, min(len(starts), CLEAN_PER_TOXIC), replace=False)
        items += [words[s:s + WINDOW] for s in chosen]
        marks += [label] * len(chosen)
    net = Network({w: i for i, w in enumerate(often)}, odds)
    _train(net, items, np.array(marks), steps)
    scorer = Scorer(net)
    highest = np.concatenate([scorer.highest(texts[i:i + 500]) for i in range(0, len(texts), 500)])
    seen = ~np.isinf(highest)
    h, t, w = highest[seen], y[seen], np.where(y[seen] == 1, weights[1], weights[0])
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps on a line of two parameters
        p = 1 / (1 + np.exp(-np.clip(slope * h + shift, -30, 30)))
        g = np.array([(w * (p - t) * h).sum() + 0.01 * (slope - 1), (w * (p - t)).sum()])
        q = w * p * (1 - p) + 1e-6
        move = np.linalg.solve(np.array([[(q * h * h).sum() + 0.01, (q * h).sum()], [(q * h).sum(), q.sum()]]), g)
        slope, shift = slope - np.clip(move[0], -1, 1), shift - np.clip(move[1], -2, 2)
    return Model(net, float(slope), float(shift), base)


def toxicity_scores(
    documents: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held: int = 0,
    id_col: str = "doc_id", text_col: str = "text", most_per_class: int = MOST_PER_CLASS, doc_bytes: int = DOC_BYTES,
) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Learns from about ``most_per_class`` labelled documents of each class that
    are not held out and at most ``doc_bytes`` long; scores whole texts of any
    length. NULL texts and texts without letters have the share of toxic
    labels as their score. NULL ids are scored, never learned from and not
    held out. Without labels of both classes all scores are that share. An
    empty table gives no rows; other columns are ignored.
    """
    allowed = labelled(labels, label, ~held_out(modulus, held))
    totals = {r["label"]: r["count"] for r in allowed.groupBy("label").count().collect()}
    chosen = sample(allowed, "label", most_per_class)
    rows = bodies(documents.filter(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) <= doc_bytes), id_col, text_col)
    # the sample is bounded by its parameters, whatever the size of the tables
    taken = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "body", "label").toArrow().sort_by("doc_id")
    y = taken.column("label").to_numpy().astype(np.int64)
    weights = tuple(totals.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1))
    model = fit(taken.column("body").to_pylist(), y, weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.net) if model.net else None
        for batch in slices(batches, "body", SLICE_BYTES):
            texts = batch.column("body").to_pylist()
            highest = scorer.highest(texts) if scorer else np.zeros(len(texts))
            s = model.scores(highest)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)),
            ], ["doc_id", "held_out", "score", "predicted"])

    found = bodies(documents, id_col, text_col)
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "body", held_out(modulus, held).alias("held_out")).mapInArrow(
        score, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}

"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum over all ways to cut it into pieces,
computed by the forward algorithm; a text's is the product over its words. The
probabilities are fitted by expectation maximisation (forward and backward)
on a bounded sample of documents per language.

Words are runs of letters, in lower case, with a mark for the word's start.
Runs of over ``RUN`` letters are cut into runs of that length first. A batch's
distinct words are scored once, all positions of many words at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .arrow import releasing, slices
from .common import remainder, table
from .sampling import sample
from .texts import pieces

DOCS_PER_LANGUAGE = 800
DOC_BYTES = 20_000
ROUNDS = 2
RUN = 48
PIECE = 8
SLICE_BYTES = 2 << 20
CACHED_WORDS = 150_000
BATCH_WORDS = 8_000
SMOOTHING = 0.1
UNKNOWN = 1e-7
START = "▁"
LETTERS = re.compile(r"[^\W\d_]+")


def vocabulary(path: str) -> list[str]:
    """The vocabulary's pieces of lower-case letters, up to ``PIECE`` letters and a start mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    plain = {p: p.removeprefix(START) for p in found}
    return sorted({START} | {p for p, body in plain.items() if body.isalpha() and len(body) <= PIECE})


def words_of(body: bytes) -> list[str]:
    """Runs of letters in lower case."""
    return LETTERS.findall(body.decode("utf-8", "replace").lower())


class Lattice:
    """Finds the pieces at all places of many words with a trie kept as one table."""

    def __init__(self, vocab: list[str]):
        chars = sorted({c for p in vocab for c in p})
        self.codes = {c: i + 1 for i, c in enumerate(chars)}
        self.depth, width = max(map(len, vocab)), len(chars) + 1
        children, piece = [{}], [-1]
        for k, p in enumerate(vocab):
            node = 0
            for c in p:
                c = self.codes[c]
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    piece.append(-1)
                node = children[node][c]
            piece[node] = k
        edges = [(n * width + c, to) for n, kids in enumerate(children) for c, to in kids.items()]
        keys, to = np.array(sorted(edges), np.int64).T
        # sparse edges: one sorted key (node, letter) per edge, found by binary search
        self.width, self.unknown = width, len(vocab)
        self.keys, self.to = keys, to.astype(np.int32)
        self.piece = np.array(piece, np.int32)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The child of each node by each letter; 0 where there is none."""
        wanted = node.astype(np.int64) * self.width + code
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.to[at], 0)

    def pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``[length - 1, place, word]`` piece numbers, -1 where there is none, and the words' lengths.

        A letter that is no piece has the number of the unknown piece.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        longest = int(sizes.max())
        codes = np.zeros((longest + self.depth, len(words)), np.int32)
        get = self.codes.get
        flat = np.fromiter((get(c, 0) for w in words for c in w), np.int32, int(sizes.sum()))
        of = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        codes[place, of] = flat
        found = np.empty((self.depth, longest, len(words)), np.int32)
        node = np.zeros((longest, len(words)), np.int32)
        for length in range(self.depth):
            letters = codes[length:length + longest]
            # only a first letter starts at the root; no match leads nowhere
            node = self.step(node, letters) if not length else np.where(node > 0, self.step(node, letters), 0)
            found[length] = np.where(node > 0, self.piece[node], -1)
        inside = np.arange(longest)[:, None] < sizes[None, :]
        found[0] = np.where(inside & (found[0] < 0), self.unknown, found[0])
        return found, sizes


def forward(found: np.ndarray, sizes: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, over all its segmentations."""
    depth, longest, n = found.shape
    table_ = np.vstack([probs, np.zeros((1, probs.shape[1]))])
    alpha = np.zeros((longest + 1, n, probs.shape[1]))
    alpha[0] = 1
    logs, out = np.zeros((n, probs.shape[1])), np.zeros((n, probs.shape[1]))
    for j in range(1, longest + 1):
        for length in range(1, min(depth, j) + 1):
            ids = found[length - 1, j - length]
            hit = np.flatnonzero(ids >= 0)
            alpha[j, hit] += alpha[j - length, hit] * table_[ids[hit]]
        if j % 8 == 0:
            recent = alpha[max(0, j - depth + 1):j + 1]
            scale = np.maximum(recent.max(axis=0), 1e-300)
            recent /= scale
            logs += np.log(scale)
        done = sizes == j
        if done.any():
            out[done] = np.log(np.maximum(alpha[j, done], 1e-300)) + logs[done]
    return out


def expected(found: np.ndarray, sizes: np.ndarray, probs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected piece counts of one language over all segmentations of the words."""
    depth, longest, n = found.shape
    p = np.append(probs, 0.0)
    alpha, beta = np.zeros((longest + 1, n)), np.zeros((longest + 1, n))
    alpha[0] = 1
    for j in range(1, longest + 1):
        for length in range(1, min(depth, j) + 1):
            alpha[j] += alpha[j - length] * p[found[length - 1, j - length]]
    beta[sizes, np.arange(n)] = 1
    for i in range(longest - 1, -1, -1):
        for length in range(1, min(depth, longest - i) + 1):
            beta[i] += beta[i + length] * p[found[length - 1, i]]
    share = weights / np.maximum(beta[0], 1e-300)
    counts = np.zeros(len(probs))
    for i in range(longest):
        for length in range(1, min(depth, longest - i) + 1):
            ids = found[length - 1, i]
            hit = ids >= 0
            mass = alpha[i] * p[ids] * beta[i + length] * share
            counts += np.bincount(ids[hit], mass[hit], len(probs))
    return counts


def fit(lattice: Lattice, counts: dict[str, dict[str, int]], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and piece probabilities (pieces and the unknown one, languages)."""
    languages = sorted(counts)
    probs = np.full((lattice.unknown + 1, len(languages)), 1.0 / (lattice.unknown + 1))
    for k, language in enumerate(languages):
        words = sorted(counts[language], key=len)
        for _ in range(rounds):
            sums = np.zeros(lattice.unknown + 1)
            for start in range(0, len(words), BATCH_WORDS):
                part = words[start:start + BATCH_WORDS]
                weights = np.array([counts[language][w] for w in part], np.float64)
                sums += expected(*lattice.pieces(part), probs[:, k], weights)
            sums += SMOOTHING
            probs[:, k] = sums / sums.sum()
        probs[-1, k] = UNKNOWN
    return languages, probs


def _runs(word: str) -> list[str]:
    """The word as the model sees it: letters only, start mark, bounded length."""
    if not word.isalpha():
        word = "".join(c for c in word if c.isalpha())
    word = START + word if word else ""
    return [word[i:i + RUN] for i in range(0, len(word), RUN)]


class Scorer:
    """Scores texts; keeps the words it has seen."""

    def __init__(self, lattice: Lattice, probs: np.ndarray):
        self.lattice, self.probs = lattice, probs
        self.clear()

    def clear(self) -> None:
        self.rows, self.logs = {}, np.zeros((0, self.probs.shape[1]))

    def _learn(self, words: list[str]) -> None:
        cut = [_runs(w) for w in words]
        runs = sorted({r for parts in cut for r in parts}, key=len)
        known = np.zeros((len(runs), self.probs.shape[1]))
        for start in range(0, len(runs), BATCH_WORDS):
            part = runs[start:start + BATCH_WORDS]
            known[start:start + len(part)] = forward(*self.lattice.pieces(part), self.probs)
        place = {r: i for i, r in enumerate(runs)}
        logs = np.array([known[[place[r] for r in parts]].sum(axis=0) if len(parts) != 1 else known[place[parts[0]]] for parts in cut])
        logs[[not parts for parts in cut]] = np.nan
        base = len(self.logs)
        self.logs = np.vstack([self.logs, logs])
        self.rows.update(zip(words, range(base, base + len(words))))

    def score(self, body: bytes) -> np.ndarray | None:
        """Log probability in each language; None without a letter."""
        total, seen = np.zeros(self.probs.shape[1]), False
        for part in pieces(body, SLICE_BYTES):
            words = words_of(part)
            ids = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
            logs = self.logs[ids]
            real = ~np.isnan(logs[:, 0])
            seen |= bool(real.any())
            total += logs[real].sum(axis=0)
        return total if seen else None

    def prepare(self, texts: list[bytes]) -> None:
        if len(self.rows) > CACHED_WORDS:
            self.clear()
        new = set()
        for body in texts:
            for part in pieces(body, SLICE_BYTES):
                new.update(words_of(part))
        new.difference_update(self.rows)
        if new:
            self._learn(sorted(new))


def learn_languages(
    documents: DataFrame, vocab: list[str], modulus: int, held: int, id_col: str, text_col: str, lang_col: str,
    docs_per_language: int, doc_bytes: int,
) -> tuple[list[str], np.ndarray]:
    """Fit on about ``docs_per_language`` documents of at most ``doc_bytes`` bytes per language."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(
        (remainder(F.col("doc_id"), modulus) != held) & F.col("lang").isNotNull() & (F.octet_length("text") <= doc_bytes)
    )
    chosen = sample(rows, "lang", docs_per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                counts.setdefault(lang, Counter()).update(
                    r for w in words_of(text) for r in _runs(w)
                )
        for lang, words in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words)), pa.array(list(words)), pa.array(list(words.values()), pa.int64())],
                ["lang", "word", "n"],
            )

    counted = chosen.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(
        releasing(count), "lang string, word string, n bigint"
    ).groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in zip(*(counted.column(c).to_pylist() for c in ("lang", "word", "n"))):
        counts.setdefault(lang, {})[word] = n
    return fit(Lattice(vocab), {lang: dict(sorted(words.items())) for lang, words in sorted(counts.items())})


def tagged(
    documents: DataFrame, vocab_path: str, *passed: Column, modulus: int = 4, held: int = 2, id_col: str = "doc_id",
    text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, doc_bytes: int = DOC_BYTES,
    inside: bool = False,
) -> DataFrame:
    """The columns ``passed`` of every row, with ``lang_pred`` and ``score``.

    With ``inside`` the first column passed is a struct that holds the text, which then travels once.
    """
    vocab = vocabulary(vocab_path)
    names, probs = learn_languages(
        documents, vocab, modulus, held, id_col, text_col, lang_col, docs_per_language, doc_bytes
    )

    def with_body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.struct_field(batch.column(0), [text_col]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pc.fill_null(text, b""), *batch.columns], ["body", *batch.schema.names])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Lattice(vocab), probs) if names else None
        for batch in slices(with_body(batches) if inside else batches, "body", SLICE_BYTES):
            texts, found, scores = batch.column("body").to_pylist(), [], []
            if scorer:
                scorer.prepare(texts)
            for body in texts:
                logs = scorer.score(body) if scorer else None
                if logs is None:
                    found.append("und")
                    scores.append(0.0)
                else:
                    best = int(logs.argmax())
                    found.append(names[best])
                    scores.append(float(1 / np.exp(logs - logs[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names[1:], "lang_pred", "score"],
            )

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = documents.select(*([] if inside else [text.alias("body")]), *passed)
    schema = StructType([*rows.schema.fields[0 if inside else 1:], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(releasing(predict), schema)


def languages(
    documents: DataFrame, vocab_path: str, modulus: int = 4, held: int = 2, id_col: str = "doc_id",
    text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE,
    doc_bytes: int = DOC_BYTES,
) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``.

    ``score`` is the posterior of the predicted language with equal priors;
    in a tie the first language in code point order is taken. NULL texts and
    texts without a letter, and all texts if nothing could be learned, are
    ``und`` with score 0. NULL ids are scored and neither learned from nor
    held out. An empty table gives no rows; other columns are ignored.
    """
    return tagged(
        documents, vocab_path, F.col(id_col).alias("doc_id"), F.coalesce(remainder(F.col(id_col), modulus) == held, F.lit(False)).alias("held_out"),
        modulus=modulus, held=held, id_col=id_col, text_col=text_col, lang_col=lang_col,
        docs_per_language=docs_per_language, doc_bytes=doc_bytes,
    )


def recognised(documents: DataFrame, vocab_path: str, least: float = 0.5) -> DataFrame:
    """The rows of ``documents`` whose language is recognised with a score of ``least`` or more, with all columns.

    NULL and empty texts, and texts without a letter, are ``und`` and leave. A
    score of exactly ``least`` stays. Repeated rows are judged alike and stay
    or leave together. An empty table gives an empty table; other columns,
    clashing names included, are carried in a struct and come back as they were.
    """
    found = tagged(documents, vocab_path, F.struct("*").alias("row"), inside=True)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return languages(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op9_language": op9_language}
ORACLES: dict[str, str] = {}

"""Held-out accuracy of the trained operators, and their parts against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafstack.llm import language, llm_queries, quality, toxicity

SF = "/root/testdata/sf0.01"


def area(score, label):
    rank = score.rank()
    n1, n0 = label.sum(), (1 - label).sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


# a twentieth of the toxic labels has no sign in its text; the smaller tables hold out six such labels in all
@pytest.mark.parametrize("name, label, least, sf", [
    ("op1_toxicity", "toxic", 0.9, "/root/testdata/sf0.1"), ("op10_quality", "quality", 0.95, SF),
])
def test_held_out_scores(spark, name, label, least, sf):
    got = llm_queries()[name](spark, sf).toPandas()
    seen = got[got.held_out].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert (seen.predicted == seen[label]).mean() >= 0.93 and area(seen.score, seen[label]) >= least


def test_held_out_languages(spark):
    got = llm_queries()["op9_language"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    seen = got[got.held_out].merge(docs, on="doc_id")
    assert (seen.lang == seen.lang_pred).mean() >= 0.98 and got.score.between(0, 1).all()


def test_forward_sums_all_segmentations():
    vocab = ["▁", "a", "b", "ab", "ba", "▁a", "aba", "▁ab"]
    lattice, rng = language.Lattice(vocab), np.random.default_rng(0)
    probs = rng.random((len(vocab) + 1, 2))
    where = {p: k for k, p in enumerate(vocab)}

    def total(word, k):
        if not word:
            return 1.0
        out = 0.0
        for n in range(1, len(word) + 1):
            piece = where.get(word[:n], len(vocab) if n == 1 else None)
            if piece is not None:
                out += probs[piece, k] * total(word[n:], k)
        return out

    words = ["▁", "▁a", "▁abab", "▁cab", "▁" + "ab" * 12]
    got = language.forward(*lattice.pieces(words), probs)
    assert np.allclose(got, [[np.log(total(w, k)) for k in (0, 1)] for w in words])
    counts = language.expected(*lattice.pieces(words), probs[:, 0], np.ones(len(words)))
    letters = sum(c * len(p) for c, p in zip(counts, [*vocab, "c"]))
    assert np.isclose(letters, sum(map(len, words)))


def test_trees_split_and_stay_flat():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = quality.fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95
    assert np.allclose(quality.fit(x, np.ones(2000)).score(x), quality.fit(x, np.ones(2000)).score(x)[0])
    assert quality.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3


def test_quality_does_not_depend_on_the_bound_of_the_sample(spark):
    """Labels of 80 % ones, of which the text tells a little: a sample of equal classes must not halve the odds."""
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("some words and "), F.expr("repeat('x', int(id % 13))")).alias("text")
    )
    share = F.when(F.col("doc_id") % 13 < 6, 70).otherwise(90)
    labels = docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(100)) < share).cast("int").alias("quality"))
    whole, capped = (
        quality.quality_scores(docs, labels, most_per_class=n).toPandas().sort_values("doc_id") for n in (10_000, 250)
    )
    assert (whole.predicted == 1).mean() > 0.95
    assert (whole.predicted.values == capped.predicted.values).mean() > 0.95
    assert abs(whole.score.mean() - capped.score.mean()) < 0.04


def test_weights_count_as_copies():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 20, (600, 3)).astype(float)
    y = (rng.random(600) < 0.2 + 0.03 * x[:, 0]).astype(float)
    copies = np.where(y == 1, 3, 1)
    weighted, repeated = quality.fit(x, y, copies.astype(float)), quality.fit(x.repeat(copies, axis=0), y.repeat(copies))
    assert np.isclose(weighted.base, repeated.base) and np.abs(weighted.score(x) - repeated.score(x)).max() < 0.05


def test_network_gradients(monkeypatch):
    rng = np.random.default_rng(0)
    net = toxicity.Network({b"aa": 0, b"bb": 1}, np.zeros(2))
    for k in net.p:
        net.p[k] = rng.normal(0, 0.5, net.p[k].shape)
    inputs, ids, y = rng.normal(0, 1, (5, 16)), np.sort(rng.integers(0, 6, (7, 4)), axis=0), np.array([1, 0, 1, 0.0])
    monkeypatch.setattr(np, "float32", np.float64)
    found, _ = net.gradients(inputs, ids, y)

    def loss():
        logits = net.logits(net.gates(inputs), ids)
        return (np.logaddexp(0, logits) - y * logits).mean()

    for k in ("wf", "ub", "uf", "cb", "attend", "out", "bias"):
        at = tuple(int(rng.integers(0, n)) for n in net.p[k].shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-4
        up = loss()
        net.p[k][at] = old - 1e-4
        down = loss()
        net.p[k][at] = old
        assert np.isclose((up - down) / 2e-4, found[k][at], atol=1e-6)


def test_all_windows_of_a_text_are_scored():
    assert toxicity.windows(5).tolist() == [0] and toxicity.windows(32).tolist() == [0]
    for n in (33, 48, 49, 1000):
        starts = toxicity.windows(n)
        assert starts[-1] + toxicity.WINDOW >= n and starts[-1] < n and set(np.diff(starts)) == {toxicity.STRIDE}


def test_toxic_words_at_any_place_of_a_long_text():
    rng = np.random.default_rng(3)
    clean = [b" ".join(rng.choice([b"the", b"house", b"tree", b"green", b"walks", b"river"], 60)) for _ in range(120)]
    toxic = [c[:100] + b" awful idiot scum " + c[100:] for c in clean[:60]]
    model = toxicity.fit([*clean[60:], *toxic], np.array([0] * 60 + [1] * 60))
    body = b" ".join(clean) * 20
    texts = [body, body + b" idiot scum", body[:50_000] + b" awful idiot " + body[50_000:]]
    scores = model.scores(toxicity.Scorer(model.net).highest(texts))
    assert scores[0] < 0.5 <= min(scores[1:])


def test_sample_of_a_billion_rows_stays_near_its_bound(spark):
    from leafstack.llm.sampling import sample

    rows = spark.range(1_000_000_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"))
    got = {r["label"]: r["count"] for r in sample(rows, "label", 800).groupBy("label").count().collect()}
    assert set(got) == {0, 1} and all(400 <= n <= 1600 for n in got.values())

"""Blocks of vectors cut into tiles: the answers of whole products, from few of the pairs."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from leafstack.functions import udfs, vectors as vec
from leafstack.operators import similarity as sim
from tests.test_similarity import answer, brute, frame


def rows(found):
    return sorted(zip(*(found.column(i).to_pylist() for i in range(3))))


def whole(q, c, ids, k, metric, query_ids=None):
    best = vec.TopK(q.astype(float), query_ids, k, metric, query_ids is not None)
    best.add_prepared(ids, vec.prepare(c.astype(float), metric))
    return rows(best.table())


def made(shape):
    rng = np.random.default_rng(4)
    if shape == "clusters":
        centres = rng.normal(size=(20, 24)) * 3
        c = centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 24)) * 0.3
    elif shape == "ties":
        c = rng.integers(0, 2, (1500, 5))
    elif shape == "narrow":
        c = rng.normal(size=(700, 1))
    elif shape == "same":
        c = np.ones((40, 6))
    elif shape == "few":
        c = rng.normal(size=(2, 6))
    elif shape == "far":
        c = rng.normal(size=(900, 8)) + 1000
    else:
        c = np.abs(rng.normal(size=(2000, 32)))
        c[5] = 0
    c = c.astype(np.float32)
    q = np.vstack([c[::7], c[:50] + np.float32(0.1), np.zeros((1, c.shape[1]))]).astype(np.float32)
    return q, c, rng.permutation(len(c)).astype(np.int64) * 3


SHAPES = ["clusters", "ties", "narrow", "same", "few", "far", "spread"]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("shape", SHAPES)
def test_same_answers_as_whole_products(shape, metric):
    q, c, ids = made(shape)
    for tile in (8, 100, 512):
        assert rows(vec.Tiles(ids, c, 3, metric, False, tile).search(q)) == whole(q, c, ids, 3, metric)


@pytest.mark.parametrize("shape", SHAPES)
def test_own_id_is_left_out(shape):
    q, c, ids = made(shape)
    numbers = np.concatenate([ids[::7], np.arange(len(q) - len(ids[::7])) + 10_000_000])
    assert rows(vec.Tiles(ids, c, 2, "l2", True, 64).search(q, numbers)) == whole(q, c, ids, 2, "l2", numbers)


@pytest.mark.parametrize("shape", SHAPES)
def test_limits_that_change_within_a_tile(shape, monkeypatch):
    monkeypatch.setattr(vec, "TILE_PAIRS", 40)
    monkeypatch.setattr(vec, "TILE_QUERIES", 16)
    q, c, ids = made(shape)
    assert rows(vec.Tiles(ids, c, 3, "l2", False, 64).search(q)) == whole(q, c, ids, 3, "l2")


def test_most_pairs_are_not_compared(monkeypatch):
    q, c, ids = made("clusters")
    met, known = [], vec._set
    monkeypatch.setattr(vec, "_set", lambda mask: met.append(len(mask)) or known(mask))
    vec.Tiles(ids, c, 3, "l2", False, 64).search(q)
    assert 0 < sum(met) < len(q) * len(c) / 3


@pytest.mark.parametrize("large", [1e18, float("inf")])
def test_blocks_with_large_numbers(spark, large):
    rng = np.random.default_rng(6)
    c, q = rng.normal(size=(300, 8)), rng.normal(size=(20, 8))
    c[7, 0] = large
    chunks = frame(spark, c)
    held = sim.assign_cells(chunks, np.zeros((1, 8)), "l2")
    found = sim._rank(sim.grid_search(frame(spark, q, name="query_id"), held, 3, "l2", False, 1, 2), 3, "l2")
    keep = np.delete(np.arange(300), 7)
    assert answer(found) == {(a, int(keep[b]), n, s) for a, b, n, s in brute(q, c[keep], 3)}


def test_tokens_hashed_together():
    rng = np.random.default_rng(8)
    tokens = ["".join(rng.choice(list("abcéß漢1"), n)) for n in rng.integers(0, 70, 3000)] + ["a" * n for n in range(54, 66)]
    column = pa.array(tokens, pa.large_string())
    want = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) if t else -1 for t in tokens]
    assert udfs._md5_heads(column).tolist() == want
    assert udfs._md5_heads(column.slice(5, 90)).tolist() == want[5:95]
    assert udfs._md5_heads(column.slice(0, 0)).tolist() == []

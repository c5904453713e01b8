"""The exact search by blocks, for vectors that no bound separates."""

import numpy as np
import pytest

from leafstack.operators import similarity as sim, vector_index
from tests.test_similarity import answer, brute, frame


@pytest.fixture(scope="module")
def spread():
    rng = np.random.default_rng(5)
    c = np.abs(rng.normal(size=(1500, 24)))
    c[400:900] = c[0]
    return np.vstack([np.abs(rng.normal(size=(300, 24))), c[:1], np.zeros((1, 24))]), c


@pytest.fixture
def no_visits(monkeypatch):
    def probes(*args):
        raise AssertionError("queries were sent to cells")

    monkeypatch.setattr(sim, "_probes", probes)
    monkeypatch.setattr(vector_index, "_probes", probes)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_spread_vectors_are_sent_to_blocks(spark, spread, no_visits, metric):
    q, c = spread
    found = sim.topk(frame(spark, q, name="query_id"), frame(spark, c), 3, metric=metric, max_bytes=0, block=400)
    assert answer(found) == brute(q, c, 3, metric)


def test_stored_index(spark, spread, no_visits, tmp_path):
    q, c = spread
    vector_index.create_index(frame(spark, c), str(tmp_path / "index"))
    found = vector_index.search(frame(spark, q, name="query_id"), str(tmp_path / "index"), 3, block=100)
    assert answer(found) == brute(q, c, 3)


def test_cells_are_listed_by_few_tasks(spark, spread, tmp_path):
    _, c = spread
    vector_index.create_index(frame(spark, c), str(tmp_path / "index"), cells=150)
    sc = spark.sparkContext
    sc.setJobGroup("listing", "cells of an index")
    vector_index._cells(spark, str(tmp_path / "index"), vector_index._manifest(spark, str(tmp_path / "index"), 0))
    tracker = sc.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    sc.setLocalProperty("spark.jobGroup.id", None)
    sizes = [tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)]
    assert sizes and max(sizes) <= 4 * max(8, sc.defaultParallelism)


@pytest.mark.parametrize("skip_same", [False, True])
def test_many_blocks(spark, spread, skip_same):
    _, c = spread
    asked, chunks = frame(spark, c[:450], name="query_id"), frame(spark, c)
    _, held, _ = sim._grouped(chunks, 4, "l2", None, skip_same)
    found = sim._rank(sim.grid_search(asked, held, 4, "l2", skip_same, 3, 5), 4, "l2")
    assert answer(found) == {r for r in brute(c, c, 4, skip_same=skip_same) if r[0] < 450}


def test_blocks_are_bounded(spark):
    q, c = sim.grid_blocks(spark, 1_000_000, 5_000_000, 64, 8192)
    assert 1_000_000 / q * 256 <= sim.GRID_BYTES and 5_000_000 / c * 256 <= sim.GRID_BYTES
    assert sim.grid_blocks(spark, 10, 100, 64, 8192) == (1, 1)


@pytest.mark.parametrize("count", [1, 12, 80])
def test_each_pair_of_blocks_has_its_partition(spark, count):
    keys = sim.block_keys(spark, count)
    placed = spark.createDataFrame([(k,) for k in keys], "block int").repartition(count, "block")
    assert placed.rdd.glom().map(len).collect() == [1] * count

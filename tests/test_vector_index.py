import numpy as np
from pyspark.sql import functions as F
import pytest

from leafstack.operators import changes, similarity, vector_index as vi
from leafstack.session import scratch_path

from .test_similarity import answer, brute, frame


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    return rng.normal(size=(20, 8))[rng.integers(0, 20, 600)] * 3 + rng.normal(size=(600, 8))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_synced_index_equals_a_fresh_search(spark, data, metric):
    root = scratch_path(spark, "index")
    old = frame(spark, data[:500])
    assert vi.create_index(old, root, metric) == 0
    new_vectors, ids = np.vstack([data[:50] + 1, data[100:]]), [*range(50), *range(100, 600)]
    new = frame(spark, new_vectors, ids)
    feed = changes.change_feed(old, new, ["id"])
    assert vi.sync(spark, root, feed) == 1 and vi.versions(spark, root) == [0, 1]
    queries = frame(spark, data[::40], name="query_id")
    fresh = answer(similarity.topk(queries, new, 4, metric=metric))
    assert answer(vi.search(queries, root, 4)) == fresh
    assert answer(vi.search(queries, root, 4, probes=1 << 20)) == fresh
    assert answer(vi.search(queries, root, 4, version=0)) == answer(similarity.topk(queries, old, 4, metric=metric))
    assert vi.sync(spark, root, feed.limit(0)) == 1


def test_untouched_cells_stay(spark, data):
    root = scratch_path(spark, "index")
    old = frame(spark, data)
    vi.create_index(old, root, cells=20)
    gone = old.filter("id = 17").selectExpr("'delete' change", "id", "embedding")
    vi.sync(spark, root, gone)
    held = [v for v, _, _ in vi._manifest(spark, root, 1).values()]
    assert held.count(1) == 1 and held.count(0) >= 15
    found = answer(vi.search(frame(spark, data[17:18], name="query_id"), root, 2))
    assert 17 not in {x[1] for x in found} and len(found) == 2


def test_cell_that_loses_all_its_vectors(spark):
    root = scratch_path(spark, "index")
    old = frame(spark, [[0, 0], [0, 1], [9, 9]])
    vi.create_index(old, root, cells=3)
    vi.sync(spark, root, old.filter("id = 2").selectExpr("'delete' change", "id", "embedding"))
    assert {x[1] for x in answer(vi.search(frame(spark, [[9, 9]], name="query_id"), root, 3))} == {0, 1}


def _cell_dirs(df):
    return {p.split("cell=")[1].split("/")[0] for p in df.inputFiles() if "cell=" in p}


def test_search_reads_only_visited_cells(spark, data, monkeypatch):
    root = scratch_path(spark, "index")
    vi.create_index(frame(spark, data), root, cells=20)
    queries = frame(spark, data[[3, 200, 400]], name="query_id")
    scans, read = [], vi._cells

    def listed(*args, **kwargs):
        df = read(*args, **kwargs)
        scans.append(_cell_dirs(df))
        return df

    monkeypatch.setattr(vi, "_cells", listed)
    answer(vi.search(queries, root, 2, probes=2))
    assert len(scans) == 1 and 1 <= len(scans[0]) <= 6
    exact = vi.search(queries, root, 2)
    assert answer(exact) == answer(similarity.topk(queries, frame(spark, data), 2))


def test_recall_curve_is_stored_and_kept(spark, data):
    root = scratch_path(spark, "index")
    old = frame(spark, data)
    vi.create_index(old, root, cells=20)
    stored = vi.curve(spark, root, 0)
    assert stored is not None and 0 < len(stored) <= vi.CURVE_VECTORS * vi.CURVE_K and list(stored) == sorted(stored)
    queries = frame(spark, data[::10], name="query_id")
    truth = {(q, i) for q, i, *_ in answer(similarity.topk(queries, old, 3))}
    got = {(q, i) for q, i, *_ in answer(vi.search(queries, root, 3, recall=0.9))}
    assert len(truth & got) >= 0.9 * len(truth)
    gone = old.filter("id < 5").selectExpr("'delete' change", "id", "embedding")
    assert vi.sync(spark, root, gone) == 1 and vi.curve(spark, root, 1) is not None


def test_a_feed_applied_twice_gives_one_version(spark, data):
    root = scratch_path(spark, "index")
    old = frame(spark, data[:300])
    vi.create_index(old, root, cells=10)
    new = frame(spark, np.vstack([data[:300], data[300:320]]), list(range(320)))
    feed = changes.change_feed(old, new, ["id"])
    assert vi.sync(spark, root, feed) == 1
    assert vi.sync(spark, root, feed) == 1
    found = answer(vi.search(frame(spark, data[305:306], name="query_id"), root, 3))
    assert len({x[1] for x in found}) == 3 and 305 in {x[1] for x in found}


def test_payload_and_filter_inside_the_index(spark, data):
    root = scratch_path(spark, "index")
    rows = frame(spark, data).withColumn("label", (F.col("id") % 7).cast("int"))
    vi.create_index(rows, root, cells=20, payload=("label",))
    queries = frame(spark, data[::60], name="query_id")
    got = answer(vi.search(queries, root, 4, where="label >= 3"))
    assert got == answer(similarity.topk(queries, rows, 4, where="label >= 3"))
    found = vi.search(queries, root, 4, payload=["label"]).collect()
    assert found and all(r.label == r.id % 7 for r in found)
    feed = changes.change_feed(rows.filter("id < 590"), rows, ["id"])
    vi.sync(spark, root, changes.change_feed(rows, rows.filter("id < 590"), ["id"]))
    assert vi.sync(spark, root, feed) == 2
    again = vi.search(queries, root, 4, where="label >= 3")
    assert answer(again) == got

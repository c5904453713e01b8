import numpy as np
import pytest
from pyspark.sql import functions as F

from leafstack.operators import similarity as sim, vector_index

SCHEMA = "id bigint, embedding array<float>"


def frame(spark, vectors, ids=None, name="id"):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, f"{name} bigint, embedding array<float>")


def brute(queries, chunks, k, metric="l2", skip_same=False):
    q = np.asarray(queries, np.float32).astype(float)
    c = np.asarray(chunks, np.float32).astype(float)
    if metric == "l2":
        key = ((q[:, None] - c[None]) ** 2).sum(2)
        score = 1 / (1 + key)
    else:
        nq, nc = np.linalg.norm(q, axis=1)[:, None], np.linalg.norm(c, axis=1)[None]
        with np.errstate(divide="ignore", invalid="ignore"):
            key = 1 - np.nan_to_num((q @ c.T) / (nq * nc))
        key = np.round(key, 12)
        score = 1 - key
    out = set()
    for i in range(len(q)):
        ids = [j for j in np.lexsort((np.arange(len(c)), key[i])) if not (skip_same and i == j)]
        out |= {(i, int(j), r + 1, round(float(score[i, j]), 6)) for r, j in enumerate(ids[:k])}
    return out


def answer(found):
    return {(r["query_id"], r["id"], r["rank"], r["score"]) for r in found.collect()}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8)) * 3
    c = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8))
    c[300:600] = c[0]
    c[700] = 0
    q = np.vstack([centres[rng.integers(0, 12, 40)] + rng.normal(size=(40, 8)), np.zeros((1, 8)), c[:1]])
    return q, c


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("max_bytes", [1 << 26, 0])
def test_exact_plans_match_brute_force(spark, data, metric, max_bytes):
    q, c = data
    found = sim.topk(frame(spark, q, name="query_id"), frame(spark, c), 3, metric=metric,
                     max_bytes=max_bytes, block=64)
    assert answer(found) == brute(q, c, 3, metric)


@pytest.mark.parametrize("max_bytes", [1 << 26, 0])
def test_skip_same(spark, data, max_bytes):
    _, c = data
    c = c[:400]
    found = sim.topk(frame(spark, c, name="query_id"), frame(spark, c), 3, skip_same=True,
                     max_bytes=max_bytes, block=50)
    assert answer(found) == brute(c, c, 3, skip_same=True)


@pytest.mark.parametrize("max_bytes", [1 << 26, 0])
def test_few_candidates_and_filters(spark, data, max_bytes):
    q, c = data
    queries, chunks = frame(spark, q[:5], name="query_id"), frame(spark, c)
    few = sim.topk(queries, chunks, 3, where="id < 2", max_bytes=max_bytes)
    assert answer(few) == brute(q[:5], c[:2], 3)
    assert sim.topk(queries, chunks, 3, where="id < 0", max_bytes=max_bytes).count() == 0
    assert sim.topk(queries.limit(0), chunks, 3, max_bytes=max_bytes).count() == 0


def test_payload(spark, data):
    q, c = data
    chunks = frame(spark, c).withColumn("note", F.concat(F.lit("n"), "id"))
    for bytes_ in (1 << 26, 0):
        rows = sim.topk(frame(spark, q[:4], name="query_id"), chunks, 2, payload=["note"],
                        max_bytes=bytes_).collect()
        assert len(rows) == 8 and all(r["note"] == f"n{r['id']}" for r in rows)


def test_copies_do_not_grow_the_search(spark, data):
    _, c = data
    assert sim.first_copies(frame(spark, c), 3).count() == 900 - 301 + 3


def recall(spark, vectors, **options):
    queries = frame(spark, vectors, name="query_id")
    found = sim.ann_topk(queries, frame(spark, vectors), 3, skip_same=True, **options)
    got = {(a, b) for a, b, *_ in answer(found)}
    want = {(a, b) for a, b, *_ in brute(vectors, vectors, 3, skip_same=True)}
    return len(got & want) / len(want)


def test_approximate_recall_on_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id")
    vectors = [r["embedding"] for r in df.collect()]
    assert recall(spark, vectors) >= 0.9


@pytest.mark.parametrize("shape", ["stored", "stored in 200 cells", "even"])
def test_default_probes_reach_the_recall(spark, monkeypatch, shape):
    """More cells than a fixed number of probes covers; fewer visits than cells, also on a stored index."""
    if shape != "even":
        df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id")
        vectors, cells = np.array([r["embedding"] for r in df.collect()]), 200 if "200" in shape else None
    else:
        vectors, cells = np.random.default_rng(8).normal(size=(2000, 8)), 500
    found, measure = [], sim.probes_for_recall
    monkeypatch.setattr(sim, "probes_for_recall", lambda *a: found.append((measure(*a), len(a[2]))) or found[-1][0])
    assert recall(spark, vectors, cells=cells) >= 0.9
    assert len(found) == 1 and found[0][0] < found[0][1]


def test_index_visits_as_many_cells_as_the_recall_needs(spark, tmp_path):
    vectors = np.random.default_rng(9).normal(size=(1500, 16))
    vector_index.create_index(frame(spark, vectors), str(tmp_path), cells=300)
    found = vector_index.search(frame(spark, vectors, name="query_id"), str(tmp_path), 3, skip_same=True, recall=0.95)
    got, want = ({x[:2] for x in rows} for rows in (answer(found), brute(vectors, vectors, 3, skip_same=True)))
    assert len(got & want) / len(want) >= 0.9


def test_few_probes_suffice_on_clusters(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(40, 16))[rng.integers(0, 40, 1500)] * 4 + rng.normal(size=(1500, 16))
    assert recall(spark, vectors, probes=6, cells=60) >= 0.9


def test_all_cells_are_exact(spark, data):
    _, c = data
    assert recall(spark, c[:300], probes=1000, block=20) == 1.0


@pytest.mark.parametrize("max_bytes", [1 << 26, 0])
def test_doubles_and_tiny_vectors(spark, max_bytes):
    """Both plans compare single-precision vectors by their whole distances."""
    rng = np.random.default_rng(5)
    for scale in (1.0, 1e-7):
        c, q = rng.normal(size=(60, 2)) * scale, rng.normal(size=(3, 2)) * scale
        chunks = frame(spark, c).withColumn("embedding", F.col("embedding").cast("array<double>"))
        found = sim.topk(frame(spark, q, name="query_id"), chunks, 3, max_bytes=max_bytes)
        assert {x[:3] for x in answer(found)} == {x[:3] for x in brute(q, c, 3)}


@pytest.mark.parametrize("max_bytes", [1 << 26, 0])
def test_unequal_widths_fail(spark, max_bytes):
    chunks = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0, 4.0, 5.0])], SCHEMA).coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "query_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="unequal width|mismatch"):
        sim.topk(queries, chunks, 1, max_bytes=max_bytes).collect()


def test_short_answers_visit_more_cells(spark, data):
    _, c = data
    found = sim.ann_topk(frame(spark, c[:5], name="query_id"), frame(spark, c[600:]), 30, probes=1, cells=150)
    assert found.groupBy("query_id").count().filter("count < 30").count() == 0


def test_bound_keeps_shuffled_rows_flat_over_tasks(spark):
    rng = np.random.default_rng(5)
    chunks_np, queries_np = rng.normal(size=(4000, 8)), rng.normal(size=(10, 8))
    queries = frame(spark, queries_np, name="query_id")
    asked = sim._vectors(queries, "query_id").toArrow()
    id_type = queries.schema["query_id"].dataType
    sizes = {}
    for tasks in (4, 64):
        chunks = frame(spark, chunks_np).repartition(tasks)
        most = sim.sample_bound(asked, chunks, 3, "l2", False)
        free = sim.scan_partial(asked, id_type, chunks, 3, "l2", False).count()
        bounded = sim.scan_partial(asked, id_type, chunks, 3, "l2", False, most).count()
        sizes[tasks] = (free, bounded)
        found = sim.scan_topk(asked, id_type, chunks, 3, "l2", False, most)
        assert answer(found) == brute(queries_np, chunks_np, 3)
    assert sizes[64][0] >= 10 * sizes[4][0] / 2
    assert sizes[64][1] <= 10 * 3 * 4 and sizes[64][1] < sizes[64][0] / 4

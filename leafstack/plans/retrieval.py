"""Similarity joins and retrieval metrics over the vector table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, feedback, similarity, vector_index
from ..session import scratch_path
from ..sources import load
from . import fixtures as fx


def label_queries(spark, sf):
    """The mean vector of each label: as many queries as there are labels."""
    items = load(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = items.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return means.groupBy("label").agg(
        F.transform(ordered, lambda p: p["x"].cast("float")).alias("embedding")
    ).select(F.col("label").cast("bigint").alias("query_id"), "embedding")


def vectors(spark, sf):
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _answer(found):
    return found.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), "score")


def d6_topk(spark, sf):
    return _answer(similarity.topk(label_queries(spark, sf), vectors(spark, sf)))


def d6_topk_cosine(spark, sf):
    return _answer(similarity.topk(label_queries(spark, sf), vectors(spark, sf), metric="cosine"))


def d6_topk_filtered(spark, sf):
    """Nearest vectors among those that pass a payload filter."""
    return _answer(
        similarity.topk(label_queries(spark, sf), vectors(spark, sf), k=5, where="label >= 3")
    )


def d6_topk_grouped(spark, sf):
    """The exact plan for query sets above the broadcast bound."""
    return _answer(
        similarity.topk(label_queries(spark, sf), vectors(spark, sf), max_bytes=0)
    )


def d7_ann_topk(spark, sf):
    """Approximate neighbours of every vector among all others."""
    queries = vectors(spark, sf).select(F.col("id").alias("query_id"), "embedding")
    return _answer(similarity.ann_topk(queries, vectors(spark, sf), skip_same=True))


def d7_ann_all_cells(spark, sf):
    """The approximate plan with every cell visited, which makes it exact."""
    return _answer(similarity.ann_topk(label_queries(spark, sf), vectors(spark, sf), probes=1 << 30))


def d6_index_filtered(spark, sf):
    """The filtered top-5 of ``d6_topk_filtered``, searched in a stored index whose cells hold the label."""
    root = scratch_path(spark, "index")
    vector_index.create_index(vectors(spark, sf), root, payload=("label",))
    return _answer(vector_index.search(label_queries(spark, sf), root, k=5, where="label >= 3"))


def d6_index_payload(spark, sf):
    """Exact top-3 from a stored index, with the label read from the index's own cells."""
    root = scratch_path(spark, "index")
    vector_index.create_index(vectors(spark, sf), root, payload=("label",))
    found = vector_index.search(label_queries(spark, sf), root, payload=["label"])
    return _answer(found).join(found.select("query_id", "id", F.col("label").cast("bigint").alias("label")), ["query_id", "id"])


def d7_ann_recall(spark, sf):
    """A stored index searched for its default recall by every vector whose id is divisible by 50.

    One row: the number of queries, whether at least 0.9 of their true
    neighbours (all vectors, exact) were found, and whether the search
    visits fewer cells than the index holds. The number of cells comes from
    the curve stored with the index, so the search reads no other cell.
    """
    rows = vectors(spark, sf).select("id", "embedding")
    root = scratch_path(spark, "index")
    version = vector_index.create_index(rows, root)
    queries = rows.filter(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "embedding")
    truth = similarity.topk(queries, rows, skip_same=True).select("query_id", "id")
    found = vector_index.search(queries, root, recall=similarity.RECALL, skip_same=True)
    probes = similarity.probes_from_curve(vector_index.curve(spark, root, version), similarity.RECALL)
    cells = len(vector_index._manifest(spark, root, version))
    hits = truth.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.agg(
        F.countDistinct("query_id").alias("n_queries"),
        (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_ok"),
    ).withColumn("fewer_cells", F.lit(probes < cells))


def e6_sync_vectors(spark, sf):
    """A stored index brought from one version of the vectors to the next, then searched exactly.

    Vectors of label 7 leave, those of label 3 come, those of label 5 change sign.
    """
    rows = vectors(spark, sf)
    old = rows.filter("label != 3").select("id", "embedding")
    moved = F.when(F.col("label") == 5, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))
    new = rows.filter("label != 7").select("id", moved.alias("embedding"))
    root = scratch_path(spark, "index")
    vector_index.create_index(old, root)
    vector_index.sync(spark, root, changes.change_feed(old, new, ["id"]))
    return _answer(vector_index.search(label_queries(spark, sf), root))


def _metrics(spark, sf, digits=6):
    found = similarity.topk(label_queries(spark, sf), vectors(spark, sf), payload=["label"])
    ranked = found.select(
        F.col("query_id").alias("question"), "rank", F.col("label").cast("bigint").alias("source")
    )
    truth = load(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("question"), F.col("label").cast("bigint").alias("source")
    )
    return feedback.retriever_metrics(ranked, truth, digits=digits)


def f7_retriever_metrics(spark, sf):
    return _metrics(spark, sf)


def f7_mean_metrics(spark, sf):
    return feedback.mean_metrics(_metrics(spark, sf, digits=None))


QUERIES = {f.__name__: f for f in (
    d6_topk, d6_topk_cosine, d6_topk_filtered, d6_topk_grouped, d7_ann_topk, d7_ann_all_cells, d7_ann_recall, d6_index_filtered, d6_index_payload, e6_sync_vectors, f7_retriever_metrics,
    f7_mean_metrics,
)}

_QUERY = """query as (
  select label as query_id, list(x::float::double order by i) as v from (
    select label, i, round(avg(x), 6) as x from (
      select label, unnest(range(0, len(embedding))) as i, unnest(embedding)::double as x from embeddings)
    group by label, i) group by label)"""


def _ranked(key: str, k: int, where: str = "true") -> str:
    return f"""scored as (
  select q.query_id, c.vec_id as id, c.label, {key} as key
  from query q, (select *, embedding::double[] as v from embeddings) c where {where}),
ranked as (
  select * from (select *, row_number() over (partition by query_id order by key, id) as rank from scored)
  where rank <= {k})"""


_L2 = "pow(list_distance(q.v, c.v), 2)"
_COSINE = "round(1 - list_cosine_similarity(q.v, c.v), 12)"
_TOPK = "select query_id::bigint as query_id, id, rank, round({score}, 6) as score from ranked"
_METRICS = """metrics as (
  select query_id::bigint as question, avg((label = query_id)::int) as precision,
    max((label = query_id)::int)::double as recall,
    sum((label = query_id)::int / log2(rank + 1)) / (
      case when sum((label = query_id)::int) >= 3 then 1 + 1 / log2(3) + 1 / log2(4)
      when sum((label = query_id)::int) = 2 then 1 + 1 / log2(3) else 1 end) as ndcg
  from ranked group by query_id)"""

_L2_TOPK = fx.with_ctes(_TOPK.format(score="1 / (1 + key)"), _QUERY, _ranked(_L2, 3))

ORACLES = {
    "d6_topk": _L2_TOPK,
    "d6_topk_grouped": _L2_TOPK,
    "d7_ann_all_cells": _L2_TOPK,
    "d7_ann_recall": """select count(*) as n_queries, true as recall_ok, true as fewer_cells
from embeddings where vec_id % 50 = 0""",
    "e6_sync_vectors": fx.with_ctes(
        _TOPK.format(score="1 / (1 + key)"), _QUERY,
        """changed as (select vec_id, label, case when label = 5 then list_transform(embedding, lambda x: -x) else embedding end as embedding
  from embeddings where label <> 7)""",
        _ranked(_L2, 3).replace("from embeddings)", "from changed)"),
    ),
    "d6_topk_cosine": fx.with_ctes(_TOPK.format(score="1 - key"), _QUERY, _ranked(_COSINE, 3)),
    "d6_topk_filtered": fx.with_ctes(
        _TOPK.format(score="1 / (1 + key)"), _QUERY, _ranked(_L2, 5, "c.label >= 3")
    ),
    "d6_index_filtered": fx.with_ctes(
        _TOPK.format(score="1 / (1 + key)"), _QUERY, _ranked(_L2, 5, "c.label >= 3")
    ),
    "d6_index_payload": fx.with_ctes(
        "select query_id::bigint as query_id, id, rank, round(1 / (1 + key), 6) as score, label::bigint as label from ranked",
        _QUERY, _ranked(_L2, 3)),
    "f7_retriever_metrics": fx.with_ctes(
        "select question, round(precision, 6) as precision, recall, round(ndcg, 6) as ndcg from metrics", _QUERY, _ranked(_L2, 3), _METRICS),
    "f7_mean_metrics": fx.with_ctes(
        """select round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(ndcg), 6) as ndcg
from metrics""",
        _QUERY, _ranked(_L2, 3), _METRICS,
    ),
}

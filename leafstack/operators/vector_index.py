"""A stored vector index: written once, kept up by changes, read by searches.

The vectors lie in plain Parquet by version and cell, a cell being the vectors
nearest to one of the leaders, which are sampled when the index is made:
``root/leaders``, ``root/data/version=3/cell=7``. A manifest per version
(``root/manifest/version=3``) names, for each cell, the version that holds it,
its size and its radius; it is written last, so a version is there once its
manifest is complete. Syncing rewrites the cells that changes touch and no
others; searching reads the leaders, the manifest and the cells it visits, and
groups nothing anew.

A search first finds, per query, the cells to visit; only the directories of
the visited cells are then given to the scan (the probe set is one row per
cell at most). An exact search does so twice: the nearest cells give a bound,
and the cells that the bound cannot rule out are read next.

Recall is kept with the index: at create and at each sync a sample of
``CURVE_VECTORS`` stored vectors is compared with all vectors once, and for
each of them the number of nearest cells that hold its true neighbours is
written to ``root/curve/version=N``. A search for a recall reads that curve
and visits as many cells as it names, without a pass over the vectors.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..defaults import BROADCAST_VECTOR_BYTES, SEARCH_BLOCK_ROWS, TOP_K
from ..functions.vectors import matrix, prepare
from ..session import few_listing_tasks, settled
from ..sources.paths import levels
from .similarity import PROBES, _probes, _rank, _search, _vectors, assign_cells, grid_pays, grid_search, sample_leaders
from .similarity import needed_cells, probes_for_recall, probes_from_curve

_CELL = "id bigint, vector binary, distance double"
#: Stored vectors whose neighbours give the recall curve, and the k it is measured for.
CURVE_VECTORS, CURVE_K = 256, TOP_K


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions, oldest first."""
    return sorted(d["version"] for d in levels(spark, f"{root}/manifest/version=*/_SUCCESS"))


def _manifest(spark: SparkSession, root: str, version: int) -> dict[int, tuple[int, int, float]]:
    """Per cell the version that holds it, its size and its radius; one row per cell, about the root of the vectors."""
    rows = spark.read.parquet(f"{root}/manifest/version={version}").collect()
    return {r["cell"]: (r["held"], r["n"], r["radius"]) for r in rows}


def payload_schema(spark: SparkSession, root: str) -> str:
    """DDL of the payload columns stored beside the vectors ('' for none)."""
    if not levels(spark, f"{root}/payload/_SUCCESS"):
        return ""
    found = spark.read.parquet(f"{root}/payload").schema
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.fields)


def _schema(spark: SparkSession, root: str) -> str:
    extra = payload_schema(spark, root)
    return f"{_CELL}, {extra}" if extra else _CELL


def _cells(spark: SparkSession, root: str, manifest: dict, cells=None) -> DataFrame:
    chosen = [(c, manifest[c][0]) for c in (manifest if cells is None else cells) if c in manifest]
    paths = [f"{root}/data/version={v}/cell={c}" for c, v in chosen]
    schema = f"{_schema(spark, root)}, version int, cell int"
    if not paths:
        return spark.createDataFrame([], schema)
    with few_listing_tasks(spark):
        return spark.read.option("basePath", f"{root}/data").schema(schema).parquet(*paths)


def _write(rows: DataFrame, root: str, version: int, manifest: dict, touched) -> None:
    spark = rows.sparkSession
    rows.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{root}/data/version={version}")
    written = spark.read.schema(f"{_schema(spark, root)}, cell int").parquet(f"{root}/data/version={version}") if not rows.isEmpty() else rows
    stats = written.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()
    kept = {c: held for c, held in manifest.items() if c not in touched}
    kept |= {r["cell"]: (version, r["n"], r["radius"]) for r in stats}
    table = [(c, *held) for c, held in sorted(kept.items())]
    spark.createDataFrame(table, "cell int, held int, n bigint, radius double").coalesce(1).write.mode("overwrite").parquet(
        f"{root}/manifest/version={version}"
    )


def _with_payload(vectors: DataFrame, payload) -> DataFrame:
    """``id, embedding`` and the payload columns, rows without either left out."""
    return _vectors(vectors, "id") if not payload else vectors.select(
        "id", F.col("embedding").cast("array<float>").alias("embedding"), *payload
    ).filter(F.col("id").isNotNull() & F.col("embedding").isNotNull())


def _placed(vectors: DataFrame, leaders, metric: str, payload) -> DataFrame:
    """Rows of cells: the nearest leader of each vector, and its payload beside it (ids are unique)."""
    rows = assign_cells(vectors.select("id", "embedding"), leaders, metric)
    return rows.join(vectors.select("id", *payload), "id") if payload else rows


def create_index(
    vectors: DataFrame, root: str, metric: str = "l2", cells: int | None = None, payload: tuple[str, ...] = (),
) -> int:
    """Make the index from ``id, embedding``; about sqrt(n) cells unless ``cells`` says otherwise.

    ``payload`` names columns stored in the cells beside the vectors, so a
    search can filter on them at the scan and return them without a join.
    """
    spark = vectors.sparkSession
    held = settled(_with_payload(vectors, payload))
    if payload:
        held.select(*payload).limit(0).write.mode("overwrite").parquet(f"{root}/payload")
    total = held.count()
    if not total:
        raise ValueError("an index needs a vector to start from")
    width = len(held.first()["embedding"])
    wanted = cells or min(math.isqrt(total), max(1, BROADCAST_VECTOR_BYTES // (8 * max(1, width))))
    leaders = sample_leaders(held, wanted)
    table = [(k, [float(x) for x in v]) for k, v in enumerate(leaders)]
    frame = spark.createDataFrame(table, "cell int, embedding array<float>")
    frame.withColumn("metric", F.lit(metric)).write.mode("overwrite").parquet(f"{root}/leaders")
    rows = _placed(held, prepare(leaders, metric), metric, list(payload))
    _write(rows, root, 0, {}, ())
    _write_curve(spark, root, 0)
    return 0


def _write_curve(spark: SparkSession, root: str, version: int) -> None:
    """Measure and store the recall curve of a version: one pass over its vectors."""
    leaders, metric = _leaders(spark, root)
    held = _cells(spark, root, _manifest(spark, root, version)).select("id", "vector", "cell")
    needed = needed_cells(_stored_vectors(held), held, leaders, CURVE_K, metric, True, CURVE_VECTORS)
    spark.createDataFrame([(int(n),) for n in needed], "needed int").coalesce(1).write.mode("overwrite").parquet(
        f"{root}/curve/version={version}")


def _stored_vectors(held: DataFrame) -> DataFrame:
    """``query_id, embedding`` of stored rows, decoded from their packed floats."""
    from ..functions.vectors import unpack

    def decode(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(unpack(batch.column(1))), pa.list_(pa.float32()))],
                names=["query_id", "embedding"])

    return held.select("id", "vector").mapInArrow(decode, "query_id bigint, embedding array<float>")


def curve(spark: SparkSession, root: str, version: int):
    """The stored recall curve of a version, sorted; None for an index made before curves were kept."""
    import numpy as np

    if not levels(spark, f"{root}/curve/version={version}/_SUCCESS"):
        return None
    return np.sort(spark.read.parquet(f"{root}/curve/version={version}").toArrow().column("needed").to_numpy())


def _leaders(spark: SparkSession, root: str):
    rows = spark.read.parquet(f"{root}/leaders").orderBy("cell").toArrow()
    metric = rows.column("metric")[0].as_py()
    return prepare(matrix(rows.column("embedding")), metric), metric


def sync(spark: SparkSession, root: str, changes: DataFrame) -> int:
    """Apply a change feed of ``id, change, embedding``; returns the version that holds the result.

    Every id that the feed names leaves its cell first; the rows after the
    change (``insert``, ``update_post``; one per id) come in. Ids are looked
    up in the index by a join that reads ids only. The cells they were in and
    the cells that new vectors fall into are written anew, and the recall
    curve is measured again. A feed that changes nothing, such as one applied
    twice, gives no new version.
    """
    version = versions(spark, root)[-1]
    manifest = _manifest(spark, root, version)
    leaders, metric = _leaders(spark, root)
    changes = settled(changes)
    named = changes.select("id").distinct()
    live = changes.filter(F.col("change").isin("insert", "update_post")).dropDuplicates(["id"])
    payload = [c.split("`")[1] for c in payload_schema(spark, root).split(", ") if c]
    fresh = settled(_placed(_with_payload(live, payload), leaders, metric, payload))
    lost = _cells(spark, root, manifest).select("id", "cell").join(named, "id", "left_semi")
    touched = {r["cell"] for r in lost.select("cell").union(fresh.select("cell")).distinct().collect()}
    if not touched:
        return version
    old = _cells(spark, root, manifest, touched).drop("version")
    rows = settled(old.join(named, "id", "left_anti").unionByName(fresh))
    if rows.exceptAll(old).isEmpty() and old.exceptAll(rows).isEmpty():
        return version
    _write(rows, root, version + 1, manifest, touched)
    _write_curve(spark, root, version + 1)
    return version + 1


def _first_copies(held: DataFrame, copies: int) -> DataFrame:
    """The lowest ids of each distinct stored vector; of others none can be an answer."""
    same = Window.partitionBy("__digest", "vector").orderBy("id")
    return held.withColumn("__digest", F.xxhash64("vector")).withColumn("__n", F.row_number().over(same)).filter(
        F.col("__n") <= copies).drop("__n", "__digest")


def search(
    queries: DataFrame, root: str, k: int = TOP_K, probes: int | None = None, version: int | None = None,
    skip_same: bool = False, block: int = SEARCH_BLOCK_ROWS, recall: float | None = None,
    where: str | None = None, payload: list[str] | None = None,
) -> DataFrame:
    """Top-k of the stored vectors: exact, or of the ``probes`` nearest cells, or of as many as ``recall`` needs.

    Only the directories of visited cells are read. With ``recall``, the
    number of cells comes from the curve stored with the version. ``where``
    filters on stored payload columns inside the scan (Parquet skips row
    groups whose ranges cannot match); an exact search stays exact, as its
    bound comes from the filtered answer. ``payload`` names stored columns
    to return with each answer. An exact search of more than ``block``
    queries compares blocks of queries with blocks of all vectors if a sample
    shows that the bound would leave most cells to visit anyway.
    """
    spark = queries.sparkSession
    version = versions(spark, root)[-1] if version is None else version
    manifest = _manifest(spark, root, version)
    leaders, metric = _leaders(spark, root)
    stats = [(c, n, radius) for c, (_, n, radius) in sorted(manifest.items())]
    asked = settled(_vectors(queries, "query_id"))
    if not stats:
        return _rank(asked.select("query_id", F.lit(0).cast("bigint").alias("id"), F.lit(0.0).alias("key")).limit(0), k, metric)
    if probes is None and recall is not None:
        stored = curve(spark, root, version)
        probes = probes_from_curve(stored, recall) if stored is not None else probes_for_recall(
            asked, _cells(spark, root, manifest).select("id", "vector", "cell"), leaders, k, metric, skip_same, recall)
    seen: set[int] = set()

    def visit(probed: DataFrame) -> DataFrame:
        cells = sorted(r["cell"] for r in probed.select("cell").distinct().collect())
        seen.update(cells)
        held = _cells(spark, root, manifest, cells)
        held = held.filter(where) if where is not None else held
        return _search(probed, held.select("id", "vector", "cell", "distance"), stats, k, metric, skip_same, block)

    def attach(found: DataFrame) -> DataFrame:
        """Payload of the answers, from the cells visited (the answers lie in them)."""
        if not payload:
            return found
        return found.join(_cells(spark, root, manifest, sorted(seen)).select("id", *payload), "id")

    if probes is None and asked.count() > block:
        held = _cells(spark, root, manifest)
        held = (held.filter(where) if where is not None else held).select("id", "vector")
        blocks = grid_pays(asked, held, leaders, stats, k, metric, skip_same, block)
        if blocks:
            seen.update(manifest)
            return attach(_rank(grid_search(asked, _first_copies(held, k + skip_same), k, metric, skip_same, *blocks), k, metric))
    shipped = spark.sparkContext.broadcast(leaders)
    unbounded = asked.withColumn("most", F.lit(float("inf")))
    count = min(len(leaders), probes or PROBES)
    first = visit(settled(_probes(unbounded, shipped, stats, count, metric)))
    if probes is not None:
        first = settled(first)
        full = first.groupBy("query_id").count().filter(F.col("count") >= k).select("query_id")
        short = settled(asked.join(full, "query_id", "left_anti"))
        if count < len(leaders) and not short.isEmpty():
            every = settled(_probes(short.withColumn("most", F.lit(float("inf"))), shipped, stats, len(leaders), metric))
            first = first.join(full, "query_id", "left_semi").unionByName(visit(every))
        return attach(_rank(first, k, metric))
    nearest = Window.partitionBy("query_id").orderBy("key", "id")
    bounds = first.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") == k).select(
        "query_id", F.col("key").alias("most"))
    bounded = asked.join(bounds, "query_id", "left").select(
        "query_id", "embedding", F.coalesce("most", F.lit(float("inf"))).alias("most"))
    return attach(_rank(visit(settled(_probes(bounded, shipped, stats, None, metric))), k, metric))

"""Top-k similarity joins: k nearest chunks for each query vector.

``queries`` has ``query_id`` and ``embedding``, ``chunks`` has ``id bigint``
and ``embedding``. The answer has ``query_id, id, rank, score``; equal scores
are ordered by id.

Four plans give it. If the query vectors are known to be few, they travel to
the scan of the chunks, which keeps k per query and task and shuffles only
these. Otherwise chunks are grouped around sampled leader vectors, each query
visits cells of this grouping, and the visits run as a cogroup whose groups
are split to a fixed size. Visiting a number of cells is approximate, by
default as many as reach a recall measured on a sample of the queries;
visiting every cell that a distance bound cannot rule out is exact. Where that
bound rules out little (a sample of the queries tells), an exact search meets
large blocks of queries with large blocks of chunks instead, which sends a
vector to a few blocks and not to most of the cells.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..defaults import BROADCAST_VECTOR_BYTES, GRID_BYTES, SEARCH_BLOCK_ROWS, TOP_K
from ..functions.vectors import Tiles, TopK, matrix, pack, prepare, squared, tileable, unpack, unpack_single
from ..session import settled

_METRICS = ("l2", "cosine")
#: Queries of a grid block that are compared at a time, by tiles and by whole products.
GRID_QUERIES, PRODUCT_QUERIES = 1 << 16, 1024
#: Cells of the first visit of an exact search, which only bounds the distance.
PROBES = 32
#: Of the true neighbours of so many sampled queries, an approximate search finds at least this share.
RECALL, RECALL_QUERIES, RECALL_SEED = 0.95, 256, 17
#: Chunks that give each query of the broadcast plan a bound on its k-th key.
BOUND_CHUNKS = 2048


def _vectors(df: DataFrame, id_col: str) -> DataFrame:
    """Ids and vectors, in single precision in every plan."""
    return df.select(id_col, F.col("embedding").cast("array<float>").alias("embedding")).filter(
        F.col(id_col).isNotNull() & F.col("embedding").isNotNull()
    )


def _score(metric: str) -> Column:
    key = F.col("key")
    return (1.0 / (1.0 + key)) if metric == "l2" else (1.0 - key)


def _rank(partial: DataFrame, k: int, metric: str) -> DataFrame:
    """Best k of the partial answers; the limit also applies before the shuffle."""
    nearest = Window.partitionBy("query_id").orderBy("key", "id")
    return (
        partial.withColumn("rank", F.row_number().over(nearest))
        .filter(F.col("rank") <= k)
        .select("query_id", "id", "rank", F.round(_score(metric), 6).alias("score"))
    )


def few_queries(asked: DataFrame, max_bytes: int = BROADCAST_VECTOR_BYTES) -> pa.Table | None:
    """The vectors of ``asked`` if they fit the bound, else None.

    ``asked`` is counted first; it should be a written frame, so that neither
    the count nor the read runs the embedding again.
    """
    size = F.size("embedding")
    rows, width, least = asked.agg(F.count(F.lit(1)), F.max(size), F.min(size)).first()
    if not rows:
        return asked.toArrow()
    if width != least:
        raise ValueError("vectors of unequal width")
    return asked.toArrow() if rows * width * 8 <= max_bytes else None


def scan_topk(
    rows: pa.Table, id_type: T.DataType, chunks: DataFrame, k: int, metric: str, skip_same: bool,
    most: np.ndarray | None = None,
) -> DataFrame:
    """Queries sent to the chunks: one pass over the chunks, no shuffle of vectors."""
    return _rank(scan_partial(rows, id_type, chunks, k, metric, skip_same, most), k, metric)


def scan_partial(
    rows: pa.Table, id_type: T.DataType, chunks: DataFrame, k: int, metric: str, skip_same: bool,
    most: np.ndarray | None = None,
) -> DataFrame:
    """Each task's candidates: at most k per query, and none beyond ``most`` (per query) where given."""
    spark = chunks.sparkSession
    schema = T.StructType([
        T.StructField("query_id", id_type), T.StructField("id", T.LongType()),
        T.StructField("key", T.DoubleType()),
    ])
    if not len(rows):
        return spark.createDataFrame([], schema)
    shipped = spark.sparkContext.broadcast(
        (rows.column("query_id").to_pylist(), matrix(rows.column("embedding")), np.inf if most is None else most)
    )

    def search(batches):
        ids, vectors, bound = shipped.value
        best = TopK(vectors, ids, k, metric, skip_same, bound)
        for batch in batches:
            best.add(np.asarray(batch.column(0), dtype=np.int64), matrix(batch.column(1)))
        found = best.table()
        query = pa.array(ids).take(found.column(0))
        yield pa.RecordBatch.from_arrays(
            [query, found.column(1), found.column(2)], names=["query_id", "id", "key"]
        )

    return _vectors(chunks, "id").mapInArrow(search, schema)


def sample_bound(rows: pa.Table, chunks: DataFrame, k: int, metric: str, skip_same: bool, size: int = BOUND_CHUNKS) -> np.ndarray:
    """Per query, the k-th key among the first ``size`` chunks: no answer lies beyond it.

    Any chunks give an upper bound on the true k-th key, so the first ones
    are taken (Spark reads no more than it needs for them); where they hold
    fewer than k, the bound is infinite.
    """
    some = _vectors(chunks, "id").limit(size).toArrow()
    best = TopK(matrix(rows.column("embedding")), rows.column("query_id").to_pylist(), k, metric, skip_same)
    if len(some):
        best.add(np.asarray(some.column("id"), dtype=np.int64), matrix(some.column("embedding")))
    return best.key.max(axis=1) if len(rows) else np.zeros(0)


# Grouping around leaders

def first_copies(chunks: DataFrame, copies: int) -> DataFrame:
    """The lowest ids of each distinct vector.

    Of identical vectors only the first ``k`` by id can be in an answer, so
    this loses nothing, and a vector that fills a third of the table shrinks
    to ``k`` rows before the shuffle.
    """
    # The digest comes first, so that sorting seldom has to compare whole vectors.
    same = Window.partitionBy("__digest", "embedding").orderBy("id")
    return (
        _vectors(chunks, "id").withColumn("__digest", F.xxhash64("embedding"))
        .withColumn("__n", F.row_number().over(same))
        .filter(F.col("__n") <= copies).drop("__n", "__digest")
    )


def sample_leaders(chunks: DataFrame, cells: int) -> np.ndarray:
    """``cells`` vectors, picked by the hash of the id: dense regions get more of them."""
    picked = chunks.orderBy(F.xxhash64("id"), "id").limit(cells).select("embedding")
    return matrix(picked.toArrow().column("embedding"))


def _slices(rows: int, leaders: np.ndarray):
    """Row ranges whose distances to all leaders take some 30 MB."""
    step = max(1, (1 << 22) // len(leaders))
    return ((i, min(rows, i + step)) for i in range(0, rows, step))


def _nearest_leaders(vectors, leaders, count):
    d = squared(vectors, leaders)
    if count >= d.shape[1]:
        return np.tile(np.arange(d.shape[1]), (len(d), 1)), d
    return np.argpartition(d, count - 1, axis=1)[:, :count], d


def assign_cells(chunks: DataFrame, leaders: np.ndarray, metric: str) -> DataFrame:
    """Add the nearest leader and the distance to it."""
    shipped = chunks.sparkSession.sparkContext.broadcast(leaders)

    def assign(batches):
        for batch in batches:
            raw = matrix(batch.column(1))
            vectors = prepare(raw, metric)
            for i, j in _slices(len(vectors), shipped.value):
                part = vectors[i:j]
                d = squared(part, shipped.value)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(part)), pack(raw[i:j]),
                     pa.array(cell.astype(np.int32)),
                     pa.array(np.sqrt(d[np.arange(len(part)), cell]))],
                    names=["id", "vector", "cell", "distance"],
                )

    return chunks.mapInArrow(assign, "id bigint, vector binary, cell int, distance double")


def _probes(queries: DataFrame, shipped, stats, count: int | None, metric: str) -> DataFrame:
    """Queries with the cells to visit; ``queries`` has the largest key to look for as ``most``.

    With ``count``, the nearest cells. Without, every cell that could hold a
    vector within that key: the distance to the leader less the cell's radius
    is a lower bound on the distance to its vectors.
    """
    id_type = queries.schema["query_id"].dataType
    schema = T.StructType([
        T.StructField("query_id", id_type),
        T.StructField("vector", T.BinaryType()),
        T.StructField("cell", T.IntegerType()),
        T.StructField("most", T.DoubleType()),
    ])
    # Under l2 the key is the squared distance; on unit vectors it is half of it.
    stretch = 1.0 if metric == "l2" else 2.0

    def visit(batches):
        leaders = shipped.value
        radius = np.full(len(leaders), -np.inf)
        for cell, _, r in stats:
            radius[cell] = r
        for batch in batches:
            raw = matrix(batch.column(1))
            vectors = prepare(raw, metric)
            for i, stop in _slices(len(vectors), leaders):
                part = vectors[i:stop]
                if count is not None:
                    cells, _ = _nearest_leaders(part, leaders, count)
                    rows = np.repeat(np.arange(len(part)), cells.shape[1])
                    cells = cells.ravel()
                else:
                    bound = np.sqrt(np.asarray(batch.column(2).slice(i, len(part))) * stretch)
                    reach = bound[:, None] + radius[None, :] + 1e-6
                    rows, cells = np.nonzero(np.sqrt(squared(part, leaders)) <= reach)
                for j in range(0, len(rows), 4096):
                    some = rows[j:j + 4096] + i
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(some)), pack(raw[some]),
                         pa.array(cells[j:j + 4096].astype(np.int32)),
                         batch.column(2).take(pa.array(some))],
                        names=["query_id", "vector", "cell", "most"],
                    )

    return queries.mapInArrow(visit, schema)


def probes_for_recall(
    asked: DataFrame, held: DataFrame, leaders: np.ndarray, k: int, metric: str, skip_same: bool, recall: float,
) -> int:
    """The least number of nearest cells that hold the share ``recall`` of the neighbours of a sample of the queries."""
    return probes_from_curve(needed_cells(asked, held, leaders, k, metric, skip_same), recall)


def probes_from_curve(needed: np.ndarray, recall: float) -> int:
    """The entry of a sorted curve that covers the share ``recall`` of its queries (1 for an empty one)."""
    if not len(needed):
        return 1
    return int(needed[max(0, math.ceil(recall * len(needed)) - 1)])


def needed_cells(
    asked: DataFrame, held: DataFrame, leaders: np.ndarray, k: int, metric: str, skip_same: bool,
    sample: int = RECALL_QUERIES,
) -> np.ndarray:
    """Sorted: per true neighbour of a sampled query, how many of the query's nearest cells reach its cell.

    The neighbours are found by comparing the sample (at most ``sample``
    queries) with all vectors in one pass, which shuffles k rows per query
    and task.
    """
    # Another hash than the leaders': vectors that are leaders find their neighbours in fewer cells.
    some = asked.orderBy(F.xxhash64(F.lit(RECALL_SEED), "query_id"), "query_id").limit(sample).toArrow()
    if not len(some):
        return np.zeros(0, np.int64)
    vectors, ids = matrix(some.column("embedding")), some.column("query_id").to_pylist()
    shipped = asked.sparkSession.sparkContext.broadcast((ids, vectors))

    def scan(batches):
        ids, vectors = shipped.value
        best = TopK(vectors, ids, k, metric, skip_same)
        known = np.zeros((0, 2), np.int64)
        for batch in batches:
            found = np.asarray(batch.column(0), dtype=np.int64)
            best.add(found, unpack(batch.column(1)))
            new = np.stack([found, np.asarray(batch.column(2), dtype=np.int64)], 1)
            known = np.concatenate([known, new[np.isin(found, best.id)]])
            known = known[np.isin(known[:, 0], best.id)]
        found = best.table()
        cell = dict(known.tolist())
        yield pa.RecordBatch.from_arrays(
            [*found.columns, pa.array([cell[i] for i in found.column(1).to_pylist()], pa.int32())],
            names=["q", "id", "key", "cell"],
        )

    nearest = Window.partitionBy("q").orderBy("key", "id")
    partial = held.select("id", "vector", "cell").mapInArrow(scan, "q int, id bigint, key double, cell int")
    truth = partial.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= k).select("q", "cell").toArrow()
    if not len(truth):
        return np.zeros(0, np.int64)
    d = squared(prepare(vectors, metric), leaders)
    rows, cells = truth.column("q").to_numpy(), truth.column("cell").to_numpy()
    return np.sort((d[rows] <= d[rows, cells][:, None]).sum(1))


def _search(
    probes: DataFrame, cells: DataFrame, stats, k: int, metric: str, skip_same: bool, block: int
) -> DataFrame:
    """Compare the queries of each cell with its vectors, in blocks of bounded size.

    A cell with many vectors, or many visitors, is cut into blocks on either
    side by a hash; each block of visitors meets each block of vectors in a
    group of its own, which gives out at most k rows per visitor.
    """
    spark = probes.sparkSession
    id_type = probes.schema["query_id"].dataType
    visits = {
        r["cell"]: r["n"]
        for r in probes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    plan = [
        (cell, math.ceil(n / block), math.ceil(visits[cell] / block))
        for cell, n, _ in stats if cell in visits
    ]
    blocks = F.broadcast(spark.createDataFrame(plan, "cell int, c_blocks int, q_blocks int"))
    left = (
        probes.join(blocks, "cell")
        .withColumn("qb", F.pmod(F.xxhash64("query_id"), "q_blocks").cast("int"))
        .withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1)))
        .select("cell", "qb", "cb", "query_id", "vector", "most")
    )
    right = (
        cells.join(blocks, "cell")
        .withColumn("cb", F.pmod(F.xxhash64("id"), "c_blocks").cast("int"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
        .select("cell", "qb", "cb", "id", "vector")
    )
    schema = T.StructType([
        T.StructField("query_id", id_type), T.StructField("id", T.LongType()),
        T.StructField("key", T.DoubleType()),
    ])

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        ids = asked.column("query_id").combine_chunks()
        best = TopK(unpack(asked.column("vector")), ids.to_pylist() if skip_same else ids,
                    k, metric, skip_same, asked.column("most").to_numpy())
        if len(asked) and len(held):
            best.add(np.asarray(held.column("id"), dtype=np.int64), unpack(held.column("vector")))
        found = best.table()
        return pa.Table.from_arrays(
            [ids.take(found.column(0)), found.column(1), found.column(2)],
            names=["query_id", "id", "key"],
        )

    place = ["cell", "qb", "cb"]
    return left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(compare, schema)


def visits_left(asked: DataFrame, held: DataFrame, leaders: np.ndarray, stats, k: int, metric: str, skip_same: bool) -> float:
    """How many cells a query has to visit at least, on average over a sample of the queries and their true k-th keys.

    The sample is compared with all vectors in one pass, which shuffles k rows per query and task.
    """
    some = asked.orderBy(F.xxhash64(F.lit(RECALL_SEED), "query_id"), "query_id").limit(RECALL_QUERIES).toArrow()
    if not len(some):
        return 0.0
    vectors, ids = matrix(some.column("embedding")), some.column("query_id").to_pylist()
    shipped = asked.sparkSession.sparkContext.broadcast((ids, vectors))

    def scan(batches):
        ids, vectors = shipped.value
        best = TopK(vectors, ids, k, metric, skip_same)
        for batch in batches:
            best.add(np.asarray(batch.column(0), dtype=np.int64), unpack(batch.column(1)))
        yield best.table()

    nearest = Window.partitionBy("q").orderBy("key", "id")
    last = held.select("id", "vector").mapInArrow(scan, "q int, id bigint, key double").withColumn(
        "n", F.row_number().over(nearest)).filter(F.col("n") == k).select("q", "key").toArrow()
    bound = np.full(len(ids), np.inf)
    bound[last.column("q").to_numpy()] = last.column("key").to_numpy()
    radius = np.full(len(leaders), -np.inf)
    for cell, _, r in stats:
        radius[cell] = r
    reach = np.sqrt(bound * (1.0 if metric == "l2" else 2.0))[:, None] + radius[None, :] + 1e-6
    return float((np.sqrt(squared(prepare(vectors, metric), leaders)) <= reach).sum(1).mean())


def grid_blocks(spark: SparkSession, queries: int, chunks: int, width: int, block: int, limit: int = GRID_BYTES) -> tuple[int, int]:
    """Blocks of queries and of chunks: of ``limit`` bytes at most, and enough of them for all cores unless they are under ``block`` rows."""
    rows = max(1, limit // (4 * max(1, width)))
    q_blocks = max(1, math.ceil(queries / rows))
    spread = math.ceil(2 * spark.sparkContext.defaultParallelism / q_blocks)
    return q_blocks, max(1, math.ceil(chunks / rows), min(spread, math.ceil(chunks / block)))


def block_keys(spark: SparkSession, count: int) -> list[int]:
    """``count`` numbers that a repartition into ``count`` by them puts into one partition each."""
    found, numbers = {}, 16 * count
    while len(found) < count:
        place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(count))
        found = {r["p"]: r["n"] for r in spark.range(numbers).groupBy(place.alias("p")).agg(F.min("id").alias("n")).collect()}
        numbers *= 2
    return sorted(found.values())


def grid_search(
    asked: DataFrame, held: DataFrame, k: int, metric: str, skip_same: bool, q_blocks: int, c_blocks: int,
) -> DataFrame:
    """Every block of queries against every block of ``held`` (``id, vector``): exact, whatever the vectors look like.

    A task holds one block of either side. A query goes to ``c_blocks`` tasks,
    a vector to ``q_blocks``, and a task gives out at most k rows per query.
    """
    schema = T.StructType([
        T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("id", T.LongType()),
        T.StructField("key", T.DoubleType()),
    ])

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pack(matrix(batch.column(1)))], names=["query_id", "vector"])

    dealt = lambda name, n, salt: F.pmod(F.xxhash64(F.lit(salt), name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("query_id", "embedding").mapInArrow(
        packed, T.StructType([schema["query_id"], T.StructField("vector", T.BinaryType())])
    ).select(dealt("query_id", q_blocks, 1).alias("qb"), every(c_blocks).alias("cb"), "query_id", "vector")
    # A task per pair of blocks: the hash of a plain pair number would put several into some and none into others.
    tasks = q_blocks * c_blocks
    keys = F.lit(block_keys(asked.sparkSession, tasks))
    right = held.select(every(q_blocks).alias("qb"), dealt("id", c_blocks, 2).alias("cb"), "id", "vector")

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = [pa.Table.from_batches([], pa.schema([("query_id", asked.schema.field("query_id").type), ("id", pa.int64()), ("key", pa.float64())]))]
        if len(asked) and len(held):
            ids = np.asarray(held.column("id"), dtype=np.int64)
            vectors, q = unpack_single(held.column("vector")), unpack_single(asked.column("vector"))
            names = asked.column("query_id").combine_chunks()
            numbers = np.asarray(names) if skip_same else None
            tiled = tileable(vectors) and tileable(q)
            if tiled:
                tiles, step = Tiles(ids, vectors, k, metric, skip_same), GRID_QUERIES
            else:
                doubles, step = prepare(vectors.astype(np.float64), metric), PRODUCT_QUERIES
            for i in range(0, len(q), step):
                some = names.slice(i, step)
                if tiled:
                    found = tiles.search(q[i:i + step], numbers[i:i + step] if skip_same else None)
                else:
                    best = TopK(q[i:i + step].astype(np.float64), some.to_pylist() if skip_same else some, k, metric, skip_same)
                    best.add_prepared(ids, doubles)
                    found = best.table()
                out.append(pa.Table.from_arrays(
                    [some.take(found.column(0)), found.column(1), found.column(2)], names=["query_id", "id", "key"]))
        return pa.concat_tables(out)

    block = F.element_at(keys, F.col("qb") * c_blocks + F.col("cb") + 1).cast("int").alias("block")
    place = lambda df: df.select(block, *df.columns[2:]).repartition(tasks, "block").groupBy("block")
    return place(left).cogroup(place(right)).applyInArrow(compare, schema)


def grid_pays(asked: DataFrame, held: DataFrame, leaders, stats, k: int, metric: str, skip_same: bool, block: int) -> tuple[int, int] | None:
    """The blocks of a grid if it sends fewer vectors than an exact visit of cells would, else None."""
    queries, chunks = asked.count(), sum(n for _, n, _ in stats)
    q_blocks, c_blocks = grid_blocks(asked.sparkSession, queries, chunks, leaders.shape[1], block)
    visits = min(PROBES, len(leaders)) + visits_left(asked, held, leaders, stats, k, metric, skip_same)
    return (q_blocks, c_blocks) if queries * c_blocks + chunks * q_blocks < queries * visits else None


def _grouped(chunks, k, metric, cells, skip_same):
    """Leaders, the chunks assigned to them, and per cell its size and radius."""
    distinct = settled(first_copies(chunks, k + 1 if skip_same else k))
    total = distinct.count()
    if not total:
        return None, None, []
    width = len(distinct.select("embedding").head()[0])
    most = max(1, BROADCAST_VECTOR_BYTES // (8 * max(1, width)))
    wanted = cells or min(math.isqrt(total), most)
    leaders = prepare(sample_leaders(distinct, wanted), metric)
    held = settled(assign_cells(distinct, leaders, metric))
    stats = [
        (r["cell"], r["n"], r["r"])
        for r in held.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("r")).collect()
    ]
    return leaders, held, stats


def ann_topk(
    queries: DataFrame, chunks: DataFrame, k: int = TOP_K, where: Column | str | None = None,
    metric: str = "l2", skip_same: bool = False, payload: list[str] | None = None,
    probes: int | None = None, cells: int | None = None, block: int = SEARCH_BLOCK_ROWS,
    recall: float = RECALL,
) -> DataFrame:
    """Approximate top-k: each query looks into the ``probes`` nearest cells.

    About sqrt(n) cells are made unless ``cells`` says otherwise. Without
    ``probes``, as many cells are visited as hold the share ``recall`` of the
    true neighbours of a sample of the queries. Vectors with structure need
    few visits; on vectors spread evenly over a sphere no grouping helps, and
    a large share of the cells is visited. A query whose cells hold fewer than k vectors visits all.
    """
    assert metric in _METRICS, metric
    if where is not None:
        chunks = chunks.filter(where)
    asked = settled(_vectors(queries, "query_id"))
    grouped = _grouped(chunks, k, metric, cells, skip_same)
    return _attach(visit_cells(asked, grouped, k, metric, skip_same, probes, block, exact=False, recall=recall), chunks, payload)


def visit_cells(asked, grouped, k, metric, skip_same, probes, block, exact, recall=RECALL):
    """Visit the nearest cells; with ``exact``, then all that the answer so far leaves possible.

    Without ``exact`` and ``probes``, the number of cells follows from ``recall``.

    ``grouped`` has the leaders, the vectors with their cells, and per cell its
    number, size and radius.
    """
    leaders, held, stats = grouped
    if not stats:
        return _rank(
            asked.select("query_id", F.lit(0).cast("bigint").alias("id"), F.lit(0.0).alias("key"))
            .limit(0), k, metric,
        )
    shipped = asked.sparkSession.sparkContext.broadcast(leaders)
    if not exact and probes is None:
        probes = probes_for_recall(asked, held, leaders, k, metric, skip_same, recall)
    count = min(len(leaders), probes or PROBES)
    near = settled(
        _probes(asked.withColumn("most", F.lit(float("inf"))), shipped, stats, count, metric)
    )
    first = _search(near, held, stats, k, metric, skip_same, block)
    if not exact:
        first = settled(first)
        full = first.groupBy("query_id").count().filter(F.col("count") >= k).select("query_id")
        short = settled(asked.join(full, "query_id", "left_anti"))
        if count < len(leaders) and not short.isEmpty():
            every = settled(_probes(short.withColumn("most", F.lit(float("inf"))), shipped, stats, len(leaders), metric))
            first = first.join(full, "query_id", "left_semi").unionByName(
                _search(every, held, stats, k, metric, skip_same, block)
            )
        return _rank(first, k, metric)
    nearest = Window.partitionBy("query_id").orderBy("key", "id")
    bounds = (
        first.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") == k)
        .select("query_id", F.col("key").alias("most"))
    )
    bounded = asked.join(bounds, "query_id", "left").select(
        "query_id", "embedding", F.coalesce("most", F.lit(float("inf"))).alias("most")
    )
    again = settled(_probes(bounded, shipped, stats, None, metric))
    return _rank(_search(again, held, stats, k, metric, skip_same, block), k, metric)


def topk(
    queries: DataFrame, chunks: DataFrame, k: int = TOP_K, where: Column | str | None = None,
    metric: str = "l2", skip_same: bool = False, payload: list[str] | None = None,
    max_bytes: int = BROADCAST_VECTOR_BYTES, block: int = SEARCH_BLOCK_ROWS,
) -> DataFrame:
    """Exact top-k. The plan depends on whether the queries fit ``max_bytes``.

    ``payload`` names columns of ``chunks`` to add to the chunks found.
    """
    assert metric in _METRICS, metric
    if where is not None:
        chunks = chunks.filter(where)
    asked = settled(_vectors(queries, "query_id"))
    rows = few_queries(asked, max_bytes)
    if rows is None:
        grouped = leaders, held, stats = _grouped(chunks, k, metric, None, skip_same)
        blocks = grid_pays(asked, held, leaders, stats, k, metric, skip_same, block) if stats else None
        if blocks:
            return _attach(_rank(grid_search(asked, held, k, metric, skip_same, *blocks), k, metric), chunks, payload)
        return _attach(visit_cells(asked, grouped, k, metric, skip_same, None, block, exact=True), chunks, payload)
    most = sample_bound(rows, chunks, k, metric, skip_same)
    found = scan_topk(rows, asked.schema["query_id"].dataType, chunks, k, metric, skip_same, most)
    return _attach(found, chunks, payload)


def _attach(found, chunks, payload):
    """Payload columns by a plain join: whether an answer is small enough to broadcast is left to Spark."""
    return found.join(chunks.select("id", *payload), "id") if payload else found

"""Near duplicates by SimHash with anchor-point covering.

Fingerprints that differ in at most three of 64 bits differ in at most one bit
of one of their halves. Each half is covered by the anchors of a perfect code
of radius 1: the Hamming code of length 31, with the last bit free. A
fingerprint has one home, the anchor within the covering radius of its half,
and is replicated to all anchors that can be the home of a half within one
more bit (17 of them). Two linked fingerprints therefore meet at an anchor
that is home to one of them; there the whole fingerprints are compared.

Equal fingerprints count once. An anchor with many homes is cut into tiles of
homes that every replica visits, so no anchor is held by one task. A tile gives
out the links of a spanning forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import settled
from .arrow import bodies, releasing, slices
from .common import table
from .components import components
from .texts import pieces

WORDS = 3
SEED = 42
DISTANCE = 3
TILE_HOMES = 4096
PIECE_BYTES = 1 << 20
SLICE_BYTES = 4 << 20
CELLS = 1 << 22


def shingle_hashes(body: bytes, words: int = WORDS, seed: int = SEED, piece: int = PIECE_BYTES) -> Iterator[list[int]]:
    """Hashes of all word shingles, a list per piece; a text of fewer words has one, without words none."""
    digest, kept, yielded = xxhash.xxh64_intdigest, [], False
    for part in pieces(body, piece):
        kept += part.lower().split()
        if len(kept) >= words:
            joined = b" ".join(kept)
            sizes = np.fromiter(map(len, kept), np.int64, len(kept)) + 1
            stops = np.cumsum(sizes) - 1
            starts = (stops - sizes + 1).tolist()
            yield [digest(joined[a:b], seed) for a, b in zip(starts, stops[words - 1:].tolist())]
            kept = kept[len(kept) - words + 1:]
            yielded = True
    if kept and not yielded:
        yield [digest(b" ".join(kept), seed)]


def fingerprints_of(texts: list[bytes], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """SimHash of each text: a bit is set if it is set in over half of the shingle hashes."""
    out = np.zeros(len(texts), np.uint64)
    for i, body in enumerate(texts):
        counts, n = np.zeros(64, np.int64), 0
        for hashes in shingle_hashes(body, words, seed):
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
            n += len(hashes)
        if n:
            out[i] = np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED
) -> DataFrame:
    """``doc_id, text_key, fp`` of every row; texts without words have 0, ``text_key`` is a hash of the text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", SLICE_BYTES):
            fps = fingerprints_of(batch.column("body").to_pylist(), words, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("text_key"), pa.array(fps)], ["doc_id", "text_key", "fp"]
            )

    rows = bodies(documents, id_col, text_col, F.xxhash64(text_col).alias("text_key"))
    return rows.mapInArrow(releasing(read), "doc_id bigint, text_key bigint, fp bigint")


def _syndrome(bits31: np.ndarray) -> np.ndarray:
    """XOR of the numbers (from 1) of the set bits."""
    out = np.zeros(len(bits31), np.uint64)
    for i in range(31):
        out ^= ((bits31 >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return out


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The home of each 32-bit half, and all anchors (rows of 17) that are home to a half within one bit."""
    low, free = halves & np.uint64(0x7FFFFFFF), halves & np.uint64(0x80000000)
    power = np.concatenate([[0], 1 << np.arange(31)]).astype(np.uint64)
    s = _syndrome(low)
    home = low ^ power[s]
    seen = [home | free, home | (free ^ np.uint64(0x80000000))]
    order = np.arange(1, 32, dtype=np.uint64)
    pairs = order[None, :] ^ s[:, None]
    other = low[:, None] ^ power[order][None, :] ^ power[pairs]
    # flips j and j^s lead to the same anchor, the flip s (or none) leads home
    firsts = np.where(s[:, None] == 0, False, (order[None, :] < pairs) & (order[None, :] != s[:, None]))
    zero = s == 0
    visits = np.full((len(low), 17), np.iinfo(np.int64).max, np.int64)
    visits[:, :2] = np.stack(seen, 1).astype(np.int64)
    rows, cols = np.nonzero(firsts)
    place = np.cumsum(firsts, axis=1)[rows, cols] + 1
    visits[rows, place] = (other[rows, cols] | free[rows]).astype(np.int64)
    visits[zero, 2:] = -1
    return (home | free).astype(np.int64), visits


def _replicas(nodes: DataFrame) -> DataFrame:
    """``anchor, visit, fp``: the home (visit 0) and the replicas (visit 1) of every fingerprint, for both halves."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("fp").to_numpy(zero_copy_only=False)
            for start in range(0, len(whole), 1 << 15):
                fps = whole[start:start + (1 << 15)]
                for half in (0, 1):
                    bits = (fps.view(np.uint64) >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                    home, visits = anchors(bits)
                    used = visits >= 0
                    keys = np.concatenate([home, visits[used]]) | (half << 32)
                    values = np.concatenate([fps, np.repeat(fps, used.sum(axis=1))])
                    kind = np.concatenate([np.zeros(len(home), np.int8), np.ones(int(used.sum()), np.int8)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array(kind), pa.array(values)], ["anchor", "visit", "fp"]
                    )

    return nodes.select("fp").mapInArrow(releasing(read), "anchor bigint, visit tinyint, fp bigint")


class Tile:
    """Homes of one anchor and what is known of their connections."""

    def __init__(self):
        self.homes, self.labels = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, homes: np.ndarray) -> None:
        self.homes = np.concatenate([self.homes, homes])
        self.labels = np.arange(len(self.homes))

    def visit(self, fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links that connect all pairs of a home and a visitor within the distance."""
        n = len(self.homes)
        if not n:
            return
        step = max(1, CELLS // n)
        for start in range(0, len(fps), step):
            part = fps[start:start + step]
            near = np.bitwise_count(self.homes.view(np.uint64)[:, None] ^ part.view(np.uint64)[None, :]) <= distance
            while True:
                best = np.where(near, self.labels[:, None], n).min(axis=0)
                labels = np.minimum(self.labels, np.where(near, best[None, :], n).min(axis=1))
                moved = labels != self.labels
                if not moved.any():
                    break
                self.labels = labels
                yield self.homes[moved], self.homes[labels[moved]]
            linked = best < n
            yield part[linked], self.homes[best[linked]]


def near_links(nodes: DataFrame, distance: int = DISTANCE, tile_homes: int = TILE_HOMES) -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints within ``distance`` (3 at most) bits."""
    if distance > 3:
        raise ValueError("halves cover at most three differing bits")
    rows = _replicas(nodes)
    crowded = rows.filter("visit = 0").groupBy("anchor").count().filter(F.col("count") > tile_homes)
    crowded = settled(crowded.select("anchor", F.ceil(F.col("count") / tile_homes).cast("int").alias("tiles")))
    if crowded.isEmpty():
        tiled = rows.withColumn("tile", F.lit(0))
    else:
        tiles = F.coalesce(F.col("tiles"), F.lit(1))
        own = F.array(F.pmod(F.xxhash64("fp"), tiles).cast("int"))
        tiled = rows.join(crowded, "anchor", "left").select(
            "anchor", "visit", "fp",
            F.explode(F.when(F.col("visit") == 0, own).otherwise(F.sequence(F.lit(0), tiles - 1))).alias("tile"),
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, Tile()
        for batch in batches:
            anchor, part, kind, fps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "tile", "visit", "fp"))
            if not len(anchor):
                continue
            starts = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])]))
            stops = np.append(starts[1:], len(anchor))
            homes = np.add.reduceat((kind == 0).astype(np.int64), starts)
            work = (homes > 0) & (stops - starts - homes > 1)
            work[[0, -1]] = True
            found = []
            for a, b, h in zip(starts[work].tolist(), stops[work].tolist(), homes[work].tolist()):
                if (anchor[a], part[a]) != key:
                    key, tile = (anchor[a], part[a]), Tile()
                if h:
                    tile.add(fps[a:a + h])
                found += tile.visit(fps[a + h:b], distance)
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    placed = tiled.repartition("anchor", "tile").sortWithinPartitions("anchor", "tile", "visit")
    return placed.select("anchor", "tile", "visit", "fp").mapInArrow(releasing(compare), "a bigint, b bigint").filter("a != b")


def near_groups(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
    seed: int = SEED, distance: int = DISTANCE,
) -> DataFrame:
    """One row per input row: ``doc_id, text_key, fp, component, component_id``; ``component`` is never NULL."""
    fps = settled(fingerprints(documents, id_col, text_col, words, seed))
    nodes = settled(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(near_links(nodes, distance))
    placed = settled(nodes.join(labels, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    ))
    ids = settled(placed.groupBy("component").agg(F.min("least").alias("component_id")))
    named = settled(placed.join(ids, "component").select("fp", "component", "component_id"))
    return fps.join(named, "fp")


def near_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
    seed: int = SEED, distance: int = DISTANCE,
) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    Components are chains of links; the id is the smallest document id in one.
    NULL texts count as empty; all texts without words share the fingerprint
    0. NULL ids are never the smallest; a component of NULL ids has a NULL id.
    Repeated rows come out as often as they come in. An empty table gives no
    rows; other columns are ignored.
    """
    return near_groups(documents, id_col, text_col, words, seed, distance).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that stay: one of each component, with all columns.

    The smallest id stays, NULL ids last; between texts of one id the smaller
    hash, and one of repeated rows.
    """
    groups = near_groups(documents, id_col, text_col)
    best = settled(groups.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best"),
        F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id", "text_key").alias("n_texts"),
    ))
    stays = best.select(F.col("best.doc_id").alias("__id"), F.col("best.text_key").alias("__key"))
    rows = documents.select(F.struct("*").alias("row"), F.col(id_col).alias("__doc"), F.xxhash64(text_col).alias("__text"))
    kept = rows.join(stays, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key")), "left_semi")
    if not best.filter("n_texts < n").isEmpty():
        kept = kept.dropDuplicates(["__doc", "__text"])
    return kept.select("row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates over all documents: three-word shingles, at most three differing bits."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_simhash": op2_simhash}
ORACLES: dict[str, str] = {}

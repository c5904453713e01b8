"""Distance kernels on blocks of vectors, used inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Keys are compared after cutting their rounding error, so that equal ones tie and the id decides:
# distances to this share of themselves, cosines (at most 1) to the same share of 1.
TIE = 2.0 ** -40
_PAIR_SLICE = 1 << 17
_CELLS = 1 << 22
_HALF_ULP = 2.0 ** -24
#: Vectors of a tile, queries compared with it at a time, and pairs that wait for the second comparison.
TILE, TILE_QUERIES, TILE_PAIRS = 512, 512, 1 << 20
#: Main directions that tiles are cut along, and vectors that these are found from (also those in double precision at a time).
TILE_AXES, TILE_SAMPLE = 3, 1 << 14
_LARGE = 1e15


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without NULLs as a two-dimensional array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    sizes = np.asarray(column.value_lengths())
    if n and (sizes != sizes[0]).any():
        raise ValueError("vectors of unequal width")
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def pack(vectors: np.ndarray) -> pa.Array:
    """Vectors as a binary column, which Spark moves without looking inside."""
    data = np.ascontiguousarray(vectors, dtype="<f4")
    ends = np.arange(len(data) + 1, dtype=np.int32) * (data.shape[1] * 4)
    return pa.Array.from_buffers(
        pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)]
    )


def unpack(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return unpack_single(column).astype(np.float64)


def unpack_single(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The packed vectors in single precision, not copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 0), "<f4")
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + n + 1]
    if (np.diff(ends) != ends[1] - ends[0]).any():
        raise ValueError("vectors of unequal width")
    data = np.frombuffer(column.buffers()[2], "<f4", (ends[-1] - ends[0]) // 4, ends[0])
    return data.reshape(n, -1)


def prepare(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as the metric needs them: unchanged, or of unit length."""
    if metric == "l2":
        return vectors
    norm = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0, out=d)


def _exact(a, b, rows, cols, metric):
    out = np.empty(len(rows))
    for i in range(0, len(rows), _PAIR_SLICE):
        x, y = a[rows[i:i + _PAIR_SLICE]], b[cols[i:i + _PAIR_SLICE]]
        if metric == "l2":
            out[i:i + _PAIR_SLICE] = ((x - y) ** 2).sum(1)
        else:
            out[i:i + _PAIR_SLICE] = 1.0 - (x * y).sum(1)
    if metric == "l2":
        part, exponent = np.frexp(out)
        return np.ldexp(np.round(part / TIE) * TIE, exponent)
    return np.round(out / TIE) * TIE + 0.0


def first_copies(ids: np.ndarray, vectors: np.ndarray, copies: int) -> np.ndarray:
    """Rows that are among the first ``copies`` by id of their vector."""
    order = np.argsort(ids, kind="stable")
    rows = np.ascontiguousarray(vectors[order])
    _, same = np.unique(rows.view(np.void(rows.shape[1] * rows.itemsize).dtype).ravel(),
                        return_inverse=True)
    by_copy = np.argsort(same, kind="stable")
    same = same[by_copy]
    place = np.arange(len(same)) - np.searchsorted(same, same, side="left")
    return order[by_copy[place < copies]]


class TopK:
    """The k nearest seen so far for each query of a block.

    A product in single precision is the filter: what it cannot rule out by
    more than its rounding error is computed again in double precision.
    """

    def __init__(
        self, queries: np.ndarray, query_ids, k: int, metric: str, skip_same: bool,
        most: np.ndarray | float = np.inf,
    ):
        """``most`` is the largest key worth finding, per query."""
        self.most = np.broadcast_to(most, len(queries)).astype(np.float64)
        self.q = prepare(queries, metric)
        self.q32 = self.q.astype(np.float32)
        self.size = (self.q * self.q).sum(1) if len(self.q) else np.zeros(0)
        self.qid = np.asarray(query_ids) if skip_same else query_ids
        self.k, self.metric, self.skip_same = k, metric, skip_same
        self.key = np.full((len(queries), k), np.inf)
        self.id = np.full((len(queries), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(ids) or not len(self.q):
            return
        if len(self.q) > 64:
            # Copies of one vector tie for every query; only the lowest ids can be answers.
            keep = first_copies(ids, vectors, self.k + self.skip_same)
            ids, vectors = ids[keep], vectors[keep]
        self.add_prepared(ids, prepare(vectors, self.metric))

    def add_prepared(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """As ``add``, for vectors that are prepared for the metric and of which few are the same."""
        step = max(1, _CELLS // len(self.q))
        for i in range(0, len(ids), step):
            self._add(ids[i:i + step], vectors[i:i + step])

    def _add(self, ids, c):
        q, k = self.q, self.k
        size = (c * c).sum(1)
        near = self.q32 @ c.T.astype(np.float32)
        if self.metric == "l2":
            # Squared distance without the part that is the query's own.
            near *= -2
            near += size.astype(np.float32)
            limit = self._most() - self.size
        else:
            np.negative(near, out=near)
            limit = self._most() - 1.0
        if self.skip_same:
            near[self.qid[:, None] == ids[None, :]] = np.inf
        slack = (4 * q.shape[1] + 32) * _HALF_ULP * (1.0 + self.size + size.max())
        if np.isinf(limit).any():
            limit = self._narrow(near, limit)
        mask = near <= (limit + slack)[:, None]
        if np.count_nonzero(mask) > 8 * k * len(q):
            limit = self._narrow(near, limit)
            mask = near <= (limit + slack)[:, None]
        mask &= near < np.inf
        rows, cols = np.nonzero(mask)
        if not len(rows):
            return
        held_rows, held = np.nonzero(self.key < np.inf)
        row = np.concatenate([held_rows, rows])
        key = np.concatenate([self.key[held_rows, held], _exact(q, c, rows, cols, self.metric)])
        cid = np.concatenate([self.id[held_rows, held], ids[cols]])
        order = np.lexsort((cid, key, row))
        row, key, cid = row[order], key[order], cid[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        best = place < k
        self.key[row[best], place[best]] = key[best]
        self.id[row[best], place[best]] = cid[best]

    def _most(self):
        return np.minimum(self.key[:, -1], self.most)

    def _narrow(self, near, limit):
        """The limit, or the k-th nearest of this block with its error if that is less."""
        if near.shape[1] <= self.k:
            return limit
        kth = np.partition(near, self.k - 1, axis=1)[:, self.k - 1].astype(np.float64)
        return np.minimum(limit, kth)

    def table(self) -> pa.RecordBatch:
        """What is held, as (query row, id, key)."""
        rows, cols = np.nonzero((self.key < np.inf) & (self.key <= self.most[:, None]))
        return pa.RecordBatch.from_arrays(
            [pa.array(rows.astype(np.int32)), pa.array(self.id[rows, cols]),
             pa.array(self.key[rows, cols])],
            names=["q", "id", "key"],
        )


class Tiles:
    """A block of vectors cut into tiles that a query can skip; exact, as ``TopK`` is.

    A vector also has a place: how far it lies along a few main directions, and
    the length of the rest. Places are never further apart than the vectors, so
    a query skips a tile if the box around its places lies beyond the query's
    k-th key, which a first look at the vectors around the nearest of some
    leaders bounds. Other tiles are met by a product in single precision that
    has the bound inside; what it cannot rule out by more than its rounding
    error is computed again in double precision.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, metric: str, skip_same: bool, tile: int = TILE):
        """``vectors`` are in single precision, not empty and as ``tileable`` wants them; few are the same."""
        self.ids, self.raw, self.k, self.metric, self.skip_same = ids, vectors, k, metric, skip_same
        self.c = c = _single(vectors, metric)
        self.size = _squares(c) if metric == "l2" else np.zeros(len(c))
        self.longest = float(np.sqrt(_squares(c).max()))
        rng = np.random.default_rng(len(c))
        pick = lambda n: c[rng.choice(len(c), min(len(c), n), replace=False)]
        some = pick(TILE_SAMPLE).astype(np.float64)
        self.middle = some.mean(0)
        some -= self.middle
        self.axes = np.linalg.eigh(some.T @ some)[1][:, ::-1][:, :TILE_AXES]
        places = self._places(c)
        self.reach = float(np.abs(places).max())
        self.tiles = [
            (rows, self._facing(rows), places[rows].min(0), places[rows].max(0)) for rows in _halved(places, tile)
        ]
        leaders = pick(max(1, int(np.sqrt(len(c)))))
        self.leaders = np.vstack([leaders.T, _squares(leaders)[None]]).astype(np.float32)
        cell = self._leader(c)
        by_cell = np.argsort(cell, kind="stable")
        ends = np.searchsorted(cell[by_cell], np.arange(len(leaders) + 1))
        self.cells = [by_cell[i:min(j, i + 4 * tile)] for i, j in zip(ends, ends[1:])]
        self.some = rng.choice(len(c), min(len(c), tile), replace=False)

    def _places(self, x):
        out = np.empty((len(x), self.axes.shape[1] + 1), np.float32)
        for i in range(0, len(x), TILE_SAMPLE):
            y = x[i:i + TILE_SAMPLE].astype(np.float64) - self.middle
            along = y @ self.axes
            out[i:i + len(y), :-1] = along
            out[i:i + len(y), -1] = np.sqrt(np.maximum((y * y).sum(1) - (along * along).sum(1), 0.0))
        return out

    def _facing(self, rows):
        """What the row of a query meets in the product: the vectors, their own part of the key, and ones for the bound."""
        return np.vstack([self.c[rows].T, self.size[rows].astype(np.float32)[None], np.ones((1, len(rows)), np.float32)])

    def _leader(self, x):
        out = np.empty(len(x), np.int64)
        step = max(1, _CELLS // 4 // self.leaders.shape[1])
        for i in range(0, len(x), step):
            part = x[i:i + step]
            out[i:i + step] = (np.hstack([-2 * part, np.ones((len(part), 1), np.float32)]) @ self.leaders).argmin(1)
        return out

    def _bound(self, q, sides, query_ids):
        """Per query, the k-th key among some of the vectors; infinite where they are under k."""
        out = np.full(len(q), np.inf)

        def look(mine, rows):
            if len(rows) < self.k:
                return
            facing = self._facing(rows)
            for i in range(0, len(mine), TILE_QUERIES):
                part = mine[i:i + TILE_QUERIES]
                key = sides[part] @ facing
                if self.skip_same:
                    key[query_ids[part][:, None] == self.ids[rows][None, :]] = np.inf
                out[part] = np.partition(key, self.k - 1, axis=1)[:, self.k - 1]

        cell = self._leader(q)
        by_cell = np.argsort(cell, kind="stable")
        ends = np.searchsorted(cell[by_cell], np.arange(len(self.cells) + 1))
        for rows, i, j in zip(self.cells, ends, ends[1:]):
            if i < j:
                look(by_cell[i:j], rows)
        look(np.flatnonzero(np.isinf(out)), self.some)
        return out

    def search(self, queries: np.ndarray, query_ids: np.ndarray | None = None) -> pa.RecordBatch:
        """The k nearest of each query (single precision, ``tileable``), as (query row, id, key)."""
        l2 = self.metric == "l2"
        q = _single(queries, self.metric)
        own = _squares(q) if l2 else np.ones(len(q))
        furthest = np.sqrt(_squares(q)) + self.longest
        slack = (8 * q.shape[1] + 64) * _HALF_ULP * (1.0 + furthest ** 2)
        sides = np.empty((len(q), q.shape[1] + 2), np.float32)
        np.multiply(q, np.float32(-2 if l2 else -1), out=sides[:, :-2])
        sides[:, -2], sides[:, -1] = 1, own
        limit = np.minimum(self._bound(q, sides, query_ids), furthest ** 2 if l2 else 2.0) + slack
        places = np.ascontiguousarray(self._places(q).T)
        rounding = 1e-5 * (max(self.reach, float(np.abs(places).max(initial=0.0))) + self.longest)
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        waiting, pairs = [], 0
        space = TILE_QUERIES * max(len(rows) for rows, *_ in self.tiles)
        keys, masks = np.empty(space, np.float32), np.empty(space, bool)

        def within():
            # Keys that wait are less the limit, so they compare only until it changes.
            sides[:, -1] = own - limit - slack
            return ((np.sqrt(limit * (1.0 if l2 else 2.0)) + rounding) ** 2).astype(np.float32)

        reach = within()
        for rows, facing, low, high in self.tiles:
            gap = np.zeros(len(q), np.float32)
            for place, lo, hi in zip(places, low, high):
                d = place - np.clip(place, lo, hi)
                d *= d
                gap += d
            near = np.flatnonzero(gap <= reach)
            for i in range(0, len(near), TILE_QUERIES):
                some = near[i:i + TILE_QUERIES]
                key = keys[:len(some) * len(rows)]
                np.matmul(sides[some], facing, out=key.reshape(len(some), -1))
                found = _set(np.less_equal(key, 0, out=masks[:len(key)]))
                if not len(found):
                    continue
                waiting.append((some[found // len(rows)], rows[found % len(rows)], key[found]))
                pairs += len(found)
                if pairs > TILE_PAIRS:
                    best = self._merge(queries, query_ids, slack, waiting, best)
                    full = np.flatnonzero(np.bincount(best[0], minlength=len(q)) == self.k)
                    limit[full] = np.minimum(limit[full], best[2][np.searchsorted(best[0], full, side="right") - 1])
                    waiting, pairs, reach = [], 0, within()
        row, col, key = self._merge(queries, query_ids, slack, waiting, best)
        return pa.RecordBatch.from_arrays(
            [pa.array(row.astype(np.int32)), pa.array(self.ids[col]), pa.array(key)], names=["q", "id", "key"])

    def _merge(self, queries, query_ids, slack, waiting, best):
        """The k best by key and id of those held and the pairs that wait: query rows in order, vector rows, keys."""
        if not waiting:
            return best
        row, col, near = (np.concatenate(x) for x in zip(*waiting))
        if self.skip_same:
            other = query_ids[row] != self.ids[col]
            row, col, near = row[other], col[other], near[other]
        # None of ``near`` is positive, so the bits of its opposite order it within its query row.
        order = np.argsort(row.astype(np.uint64) << np.uint64(32) | ~near.view(np.uint32))
        row, col, near = row[order], col[order], near[order]
        first = np.searchsorted(row, row, side="left")
        kth = np.minimum(first + self.k - 1, len(row) - 1)
        worth = (row[kth] != row) | (near <= near[kth] + 2 * slack[row])
        row, col = row[worth], col[worth]
        key = np.empty(len(row))
        for i in range(0, len(row), TILE_SAMPLE):
            part = slice(i, i + TILE_SAMPLE)
            x, y = (prepare(v.astype(np.float64), self.metric) for v in (queries[row[part]], self.raw[col[part]]))
            at = np.arange(len(x))
            key[part] = _exact(x, y, at, at, self.metric)
        row, col, key = (np.concatenate(x) for x in zip(best, (row, col, key)))
        order = np.lexsort((self.ids[col], key, row))
        row, col, key = row[order], col[order], key[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        return tuple(x[place < self.k] for x in (row, col, key))


def tileable(vectors: np.ndarray) -> bool:
    """Whether ``Tiles`` can hold them: numbers, and their squares in single precision too."""
    return bool(vectors.size) and float(np.abs(vectors).max()) < _LARGE


def _single(vectors, metric):
    if metric == "l2":
        return vectors
    out = np.empty_like(vectors)
    for i in range(0, len(vectors), TILE_SAMPLE):
        out[i:i + TILE_SAMPLE] = prepare(vectors[i:i + TILE_SAMPLE].astype(np.float64), metric)
    return out


def _squares(vectors):
    return np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)


def _halved(places, tile):
    """Rows in groups of ``tile`` (the last of fewer), from halving along the longest side."""
    left, out = [np.arange(len(places))], []
    while left:
        rows = left.pop()
        if len(rows) <= tile:
            out.append(rows)
            continue
        held = places[rows]
        cut = -(-len(rows) // tile) // 2 * tile
        order = np.argpartition(held[:, np.ptp(held, axis=0).argmax()], cut)
        left += [rows[order[cut:]], rows[order[:cut]]]
    return out


def _set(mask):
    """Places that are set; eight are tested at a time, as few are."""
    if len(mask) % 8:
        return np.flatnonzero(mask)
    some = np.flatnonzero(mask.view(np.uint64) != 0)
    return (some[:, None] * 8 + np.arange(8))[mask.reshape(-1, 8)[some]]

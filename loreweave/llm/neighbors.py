"""The k most similar vectors of every vector, from randomly rotated one-bit codes.

Inverted lists come from spherical k-means on a bounded sample; every vector is indexed. In a list a vector is the
sign pattern of its randomly rotated, normalised residual, one bit a component, with three correction scalars: the
residual's length, its inner product with its own sign pattern, and that with the centroid. From these the inner product with a
query is estimated without bias, with an error bound that holds with high probability; only vectors whose bound
reaches the query's k-th best so far are reranked with their full components.

A query first searches its own list, which gives it an exact k-th best, and takes that along to other lists. A list can't hold
a better one if its centroid is farther from the query, by angle, than the k-th best is plus the list's radius, its widest
member's angle. Radii are set by outliers, so a part of each is enough: the part is fitted on queries drawn from the
vectors, at most `CALIBRATION` of them, whose true neighbours are found by comparing them with every vector. It is the smallest part with
which the wanted share of those neighbours lies in lists that are searched. A wanted share of 1 searches every list that
may hold one. Equal vectors are one class that is searched once.

Neither queries nor hits move once a query and list. Lists that lie near to each other are a cell; the members of a cell, at
most `QUERIES` of them, are a group of queries that stays in a task while the lists that any of them has in reach pass by, in pieces
of `PIECE` vectors. The groups take turns in waves that send `WAVE` times all vectors at most, and what a wave leaves on disk is deleted
before the next, so disk follows the vectors, however many lists a query searches. In a wave of few groups several tasks share a group's lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, drop, sweep
from ..plans.skew import counted, hot_lookup_join
from ..sources.tables import table

#: Neighbours; vectors a list has on average; lists at most.
K, LIST, LISTS = 10, 1024, 8192
#: Vectors the centroids are fitted on: at least so many, and so many for each list (both if there are as many).
SAMPLE, PER_LIST = 40_960, 40
#: Lists from which centroids are fitted in two levels.
TWO_LEVELS = 1024
#: Members of a block, and of a piece of it that is stored in one row; queries of a group at most, and groups of small tables; width of the error bound.
BLOCK, PIECE, QUERIES, GROUPS, EPSILON = 8192, 1024, 65_536, 8, 1.9
#: Of a chunk of pairs, the part (1 in so many) from which those that may count are reranked by one product.
MANY = 64
#: Vectors sent to groups at once, as a multiple of all vectors, and at least.
WAVE, LEAST_WAVE = 2, 1 << 20
#: Queries at most on which the lists to search are fitted, and the share of their neighbours that must be in those.
CALIBRATION, RECALL = 1024, 0.995
#: Radians by which a list may seem too far and is searched still, for the rounding of single precision.
SLACK = 0.005


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(x: np.ndarray, centroid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, residual lengths, inner products with the own sign pattern, and with the centroid."""
    r = x - centroid
    length = np.linalg.norm(r, axis=1)
    rotated = (r / np.maximum(length, 1e-12)[:, None]) @ rotation(x.shape[1])
    own = np.abs(rotated).sum(axis=1) / np.sqrt(x.shape[1])
    return np.packbits(rotated > 0, axis=1), length, np.maximum(own, 1e-6), r @ centroid


def estimate(q: np.ndarray, centroid: np.ndarray, code: tuple, dim: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries with coded vectors, and their error bounds."""
    bits, length, own, with_centroid = code
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * (2 / np.sqrt(dim)) - 1 / np.sqrt(dim)
    r = q - centroid
    value = (r @ rotation(dim)) @ signs.T
    value *= length / own
    value += with_centroid
    value += (q @ centroid)[:, None]
    spread = length * np.sqrt(np.maximum(1 - own**2, 0)) / own * (epsilon / np.sqrt(dim - 1))
    return value, np.linalg.norm(r, axis=1)[:, None] * spread


def bounds(q: np.ndarray, centroid: np.ndarray, code: tuple, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices whose product is `estimate`'s values and error bounds together, of all queries and coded vectors."""
    (bits, length, own, with_centroid), dim = code, q.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * (2 / np.sqrt(dim)) - 1 / np.sqrt(dim)
    spread = length * np.sqrt(np.maximum(1 - own**2, 0)) / own * (epsilon / np.sqrt(dim - 1))
    r = q - centroid
    left, right = np.ones((len(q), dim + 3), np.float32), np.ones((len(length), dim + 3), np.float32)
    left[:, :dim], left[:, dim + 1], left[:, dim + 2] = r @ rotation(dim), q @ centroid, np.sqrt(np.einsum("nd,nd->n", r, r))
    right[:, :dim], right[:, dim], right[:, dim + 2] = signs * (length / own)[:, None], with_centroid, spread
    return left, right


def search(q: np.ndarray, x: np.ndarray, centroid: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, similarity) of each query's k best among x that reach ``least``, by codes and reranking; without codes where queries have no k-th best so far."""
    dim, out = x.shape[1], []
    code = encode(x, centroid)
    left, right = bounds(q, centroid, code)
    step = max(16, 500_000 // max(len(x), 1))
    for lo in range(0, len(q), step):
        part, floor = q[lo : lo + step], least[lo : lo + step].copy()
        if (floor < -1).any():  # no k-th best so far, which would bound what is looked at
            product = part @ x.T
            if len(x) > k:
                floor = np.maximum(floor, np.partition(product, len(x) - k - 1, axis=1)[:, len(x) - k - 1] - np.float32(1e-5))
            at = np.flatnonzero(product >= floor[:, None] - np.float32(1e-5))
        else:
            reach = left[lo : lo + step] @ right.T >= floor[:, None] - np.float32(1e-6)
            if np.count_nonzero(reach) > reach.size // MANY:  # all at once is cheaper than one by one
                reach &= part @ x.T >= floor[:, None] - np.float32(1e-5)
            at = np.flatnonzero(reach)
        i, j = at // len(x), at % len(x)
        score = np.empty(len(at), np.float32)
        for s in range(0, len(at), 65_536):
            e = slice(s, s + 65_536)
            score[e] = np.einsum("nd,nd->n", part[i[e]], x[j[e]])
        keep = score >= floor[i]
        i, j, score = i[keep], j[keep], score[keep]
        order = np.lexsort((j, -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, i)
        top = np.arange(len(i)) - first <= k  # one more, as a query may find itself
        out.append((i[top] + lo, j[top], score[top]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return tuple(np.concatenate(c) for c in zip(*out))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _usable(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(1)
        lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(lengths == dim)
        values = lists.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
        scale = np.abs(values).max(axis=1, initial=0, keepdims=True)
        with np.errstate(all="ignore"):
            unit = values / scale
            unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        good = np.isfinite(unit).all(axis=1)
        unit = unit[good].astype(np.float32) + np.float32(0)  # no negative zeros
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[good])), pa.array([r.tobytes() for r in unit], pa.binary())], names=["key", "v"])


def usable_vectors(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, v): unit vectors, once a key, as packed floats.

    Null vectors and those of another length, with null, NaN or infinite components, or all zero take no part, nor do
    null keys. Of different vectors of a key the smallest in byte order counts.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("x")).filter("key IS NOT NULL AND x IS NOT NULL")
    return rows.mapInArrow(partial(_usable, dim=dim), "key string, v binary").groupBy("key").agg(F.min("v").alias("v"))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centroids of spherical k-means."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(sample[i : i + 4096] @ c.T, axis=1) for i in range(0, len(sample), 4096)])
        order = np.argsort(near, kind="stable")
        present, start = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(sample[order], start, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c[present] = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c[present])
    return c


def fit_lists(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of all lists; many of them in two levels, coarse ones and those of the vectors nearest to each."""
    if lists < TWO_LEVELS:
        return fit_centroids(sample, lists)
    coarse = fit_centroids(sample, int(np.sqrt(lists)))
    near = np.concatenate([np.argmax(sample[i : i + 4096] @ coarse.T, axis=1) for i in range(0, len(sample), 4096)])
    parts = [sample[near == i] for i in np.unique(near)]
    return np.concatenate([fit_centroids(x, max(1, round(lists * len(x) / len(sample))), seed=i) for i, x in enumerate(parts)])


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds each vector's list, and its similarity to the centroid."""
    for b in batches:
        x = _matrix(b.column(1), centroids.shape[1])
        own, near = np.zeros(len(x), np.int32), np.zeros(len(x), np.float32)
        for i in range(0, len(x), 1024):
            s = x[i : i + 1024] @ centroids.T
            own[i : i + 1024] = s.argmax(axis=1)
            near[i : i + 1024] = s.max(axis=1)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(near)], names=[*b.schema.names, "list", "near"])


def _angle(similarity: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(similarity, -1, 1))


def within_reach(q: np.ndarray, floor: np.ndarray, centroids: np.ndarray, radius: np.ndarray, part: float = 1.0) -> np.ndarray:
    """(query, list): whether a list is searched for vectors of similarity ``floor`` or more.

    With all of the radius none is left out that holds one; with a part of it only those that are near enough.
    """
    return _angle(q @ centroids.T) - part * radius <= _angle(floor)[:, None] + SLACK


def _best_of_all(batches: Iterator[pa.RecordBatch], q: np.ndarray, floor: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(query, list, similarity) of each query's k best in a batch that reach its floor, itself left in."""
    for b in batches:
        x, lists = _matrix(b.column(0), q.shape[1]), b.column(1).to_numpy(zero_copy_only=False)
        rows, at, score = [], [], []
        for lo in range(0, len(q), 256):
            s = q[lo : lo + 256] @ x.T
            if len(x) > k:
                s = np.where(s >= np.partition(s, len(x) - k, axis=1)[:, len(x) - k, None], s, -np.inf)
            i, j = np.nonzero(s >= floor[lo : lo + 256, None])
            rows.append(i + lo)
            at.append(lists[j])
            score.append(s[i, j])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in ((rows, np.int32), (at, np.int32), (score, np.float32))], names=["query", "list", "similarity"])


def reach_part(drawn: list, member: DataFrame, centroids: np.ndarray, radius: np.ndarray, k: int, recall: float) -> float:
    """The smallest part of the radii with which the drawn queries (v, floor, own) find the share ``recall`` of their k nearest."""
    if not drawn:
        return 1.0
    q = np.frombuffer(b"".join(bytes(r.v) for r in drawn), np.float32).reshape(-1, centroids.shape[1])
    floor, own = np.array([r.floor for r in drawn], np.float32), np.array([r.own for r in drawn])
    run = partial(_best_of_all, q=q, floor=floor - np.float32(1e-6), k=k + 1)
    each = member.select("v", "list").mapInArrow(run, "query int, list int, similarity float")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "list"))
    best = each.withColumn("place", place).filter(F.col("place") <= k + 1).select("query", "list").collect()  # k + 1 a drawn query
    query, where = np.array([r[0] for r in best], int), np.array([r[1] for r in best], int)
    needed = (_angle(np.einsum("nd,nd->n", q[query], centroids[where])) - _angle(floor[query]) - SLACK) / np.maximum(radius[where], 1e-6)
    needed = np.sort(np.where(where == own[query], 0.0, np.clip(needed, 0.0, 1.0)))[len(drawn) :]  # without the queries themselves
    return max(float(np.quantile(needed, recall, method="higher")), 1e-6) if len(needed) else 1.0


_KEYS = pa.list_(pa.string())
_HITS = pa.list_(pa.struct([("key", pa.string()), ("similarity", pa.float32())]))
_PACKED = pa.schema([("group", pa.int64()), ("list", pa.int32()), ("block", pa.int32()), ("piece", pa.int32()), ("n", pa.int32()), ("rows", pa.binary()), ("asks", pa.binary())])
_PACKED_SQL = "group long, list int, block int, piece int, n int, rows binary, asks binary"


def _hits(n: int, query: np.ndarray, keys: pa.Array, vector: np.ndarray, score: np.ndarray) -> pa.Array:
    """Arrow lists of hits; the rows come sorted by query."""
    offsets = np.searchsorted(query, np.arange(n + 1)).astype(np.int32)
    found = pa.StructArray.from_arrays([keys.take(pa.array(vector)), pa.array(score, pa.float32())], fields=list(_HITS.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets), found)


def _fixed(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), x.shape[1])


def _bytes(**columns: pa.Array) -> bytes:
    """Columns as one Arrow stream; a row of a table holds many vectors in that."""
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _columns(data) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _array(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _own_list(group: pa.Table, centroids: np.ndarray, k: int, cells: int, blocks: int) -> pa.Table:
    """A block in pieces of `PIECE` members by key: keys and vectors in ``rows``, each one's best in the block and its k-th best similarity in ``asks``."""
    group = group.combine_chunks().sort_by("key").combine_chunks()
    x = _matrix(group["v"], centroids.shape[1])
    own, block = group["list"][0].as_py(), group["block"][0].as_py()
    i, j, score = search(x, x, centroids[own], np.full(len(x), -2, np.float32), k)
    other = i != j
    i, j, score = i[other], j[other], score[other]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    i, j, score, place = (a[place < k] for a in (i, j, score, place))
    at, similarity = np.full((len(x), k), -1, np.int32), np.full((len(x), k), -2, np.float32)
    at[i, place], similarity[i, place] = j, score
    out = []
    for p, lo in enumerate(range(0, len(x), PIECE)):
        e = slice(lo, lo + PIECE)
        keys, copies = (pa.concat_arrays(group[c].slice(lo, PIECE).chunks) for c in ("key", "copies"))
        rows, asks = _bytes(key=keys, copies=copies, v=_fixed(x[e])), _bytes(at=_fixed(at[e]), similarity=_fixed(similarity[e]))
        out.append((group["cell"][0].as_py() + cells * (block // blocks), own, block, p, len(x[e]), rows, asks))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _PACKED)], schema=_PACKED)


def _draw(batches: Iterator[pa.RecordBatch], dim: int, k: int, share: float) -> Iterator[pa.RecordBatch]:
    """(v, floor, own) of a part of all members."""
    for b in batches:
        v, floor, own = [], [], []
        for r in b.to_pylist():
            drawn = np.flatnonzero(np.random.default_rng([3, r["list"], r["block"], r["piece"]]).random(r["n"]) < share)
            v += [x.tobytes() for x in _array(_columns(r["rows"])["v"], dim)[drawn]]
            floor += _array(_columns(r["asks"])["similarity"], k)[drawn, -1].tolist()
            own += [r["list"]] * len(drawn)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()), pa.array(floor, pa.float32()), pa.array(own, pa.int32())], names=["v", "floor", "own"])


def _reached(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, radius: np.ndarray, part: float, k: int) -> Iterator[pa.RecordBatch]:
    """(group, list) of lists that a query of the group searches."""
    step = max(1, 1_000_000 // len(centroids))
    for b in batches:
        for r in b.to_pylist():
            q, floor = _array(_columns(r["rows"])["v"], centroids.shape[1]), _array(_columns(r["asks"])["similarity"], k)[:, -1]
            any_of = np.zeros(len(centroids), bool)
            for i in range(0, len(q), step):
                any_of |= within_reach(q[i : i + step], floor[i : i + step], centroids, radius, part).any(axis=0)
            any_of[r["list"]] = True
            lists = np.flatnonzero(any_of & np.isfinite(radius)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lists), r["group"], np.int64)), pa.array(lists)], names=["group", "list"])


class _Group:
    """The queries of a group, and the best that they have found so far.

    Several tasks may share a group's lists; ``first`` tells the one that also takes what lies in the group.
    """

    def __init__(self, first: bool, centroids: np.ndarray, radius: np.ndarray, part: float, k: int) -> None:
        self.first, self.centroids, self.radius, self.part, self.k = first, centroids, radius, part, k
        self.own: dict[tuple[int, int], list[tuple[pa.RecordBatch, pa.RecordBatch]]] = {}
        self.begun = False

    def ask(self, at: tuple[int, int], rows, asks) -> None:
        self.own.setdefault(at, []).append((_columns(rows), _columns(asks)))

    def begin(self) -> None:
        """Takes over what each query has found in its own block, and searches the blocks of the group."""
        dim, k = self.centroids.shape[1], self.k
        self.begun, every = True, [p for pieces in self.own.values() for p in pieces]
        self.q = np.concatenate([_array(rows["v"], dim) for rows, _ in every])
        self.asking, self.copies = (pa.concat_arrays([rows[c] for rows, _ in every]) for c in ("key", "copies"))
        self.list, self.block = (np.concatenate([np.full(sum(r.num_rows for r, _ in pieces), at[c]) for at, pieces in self.own.items()]) for c in (0, 1))
        start = np.concatenate([np.full(sum(r.num_rows for r, _ in pieces), lo) for pieces, lo in zip(self.own.values(), self._starts())])
        where, similarity = (np.concatenate([_array(asks[c], k) for _, asks in every]) for c in ("at", "similarity"))
        self.floor = similarity[:, -1].copy()
        self.angle = _angle(self.floor) + SLACK
        i, place = np.nonzero((where >= 0) & self.first)
        self.names, self.more, self.found, self.pending = [self.asking], [self.copies], [(i, (where + start[:, None])[i, place], similarity[i, place])], len(i)
        self.known = len(self.asking)
        for (at, block), pieces in self.own.items():
            for rows, _ in pieces * self.first:
                self.search(at, rows, block)

    def _starts(self) -> list[int]:
        return np.cumsum([0, *(sum(r.num_rows for r, _ in pieces) for pieces in self.own.values())])[:-1].tolist()

    def search(self, at: int, rows: pa.RecordBatch, block: int) -> None:
        """Searches a piece of a list with the queries that have the list in reach, those of the same block left out."""
        c = self.centroids[at]
        may = (_angle(self.q @ c) - self.part * self.radius[at] <= self.angle) | (self.list == at)
        asking = np.flatnonzero(may & ~((self.list == at) & (self.block == block)))
        if not len(asking):
            return
        x = _array(rows["v"], self.centroids.shape[1])
        for lo in range(0, len(asking), 8192):
            some = asking[lo : lo + 8192]
            i, j, score = search(self.q[some], x, c, self.floor[some], self.k)
            if len(i):
                used, j = np.unique(j, return_inverse=True)
                self.names.append(rows["key"].take(pa.array(used)))
                self.more.append(rows["copies"].take(pa.array(used)))
                self.found.append((some[i], j + self.known, score))
                self.known += len(used)
                self.pending += len(i)
            if self.pending > 2 * self.k * len(self.q) + 500_000:
                self.settle()

    def settle(self) -> None:
        """Keeps the k best of each query, the k-th of which bounds what is searched next."""
        names, more = pa.concat_arrays(self.names), pa.concat_arrays(self.more)
        i, j, score = _ranked(*(np.concatenate(c) for c in zip(*self.found)), names, np.full(len(self.q), self.k))
        count = np.bincount(i, minlength=len(self.q))
        last = np.cumsum(count) - 1
        full = count >= self.k
        self.floor[full] = np.maximum(self.floor[full], score[last[full]])
        used, j = np.unique(j, return_inverse=True)
        self.names, self.more, self.found = [names.take(pa.array(used))], [more.take(pa.array(used))], [(i, j, score)]
        self.known, self.pending = len(used), 0

    def result(self) -> pa.RecordBatch:
        """(key, copied, hits) of each query; copies of a vector are hits of their own, and those of a query's vector are hits of it."""
        if not self.begun:
            self.begin()
        self.settle()
        names, more, (i, j, score) = self.names[0], self.more[0], self.found[0]
        copied = self.copies.is_valid().to_numpy(zero_copy_only=False)
        if copied.any() or more.null_count < len(more):
            # One row of keys for all: the hits' own, their copies, and the queries' copies.
            width = [a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for a in (more, self.copies)]
            values = pa.concat_arrays([names, more.flatten(), self.copies.flatten()])
            many = width[0][j] > 0
            start = [len(names) + np.cumsum(width[0]) - width[0], len(names) + width[0].sum() + np.cumsum(width[1]) - width[1]]
            asked = np.flatnonzero(copied & self.first)
            begin = np.concatenate([np.where(many, start[0][j], j), start[1][asked]])
            size = np.concatenate([np.where(many, width[0][j], 1), width[1][asked]])
            i, score = (np.repeat(np.concatenate(c), size) for c in ((i, asked), (score, np.ones(len(asked), np.float32))))
            j = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i, j, score = _ranked(i, j, score, values, self.k + copied)
            names = values
        hits = _hits(len(self.q), i, names, j, score)
        return pa.RecordBatch.from_arrays([self.asking, pa.array(copied), hits], names=["key", "copied", "hits"])


def _ranked(i: np.ndarray, j: np.ndarray, score: np.ndarray, names: pa.Array, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``most[i]`` of each query i, best first, ties by key."""
    bits = (score + np.float32(0)).view(np.uint32)
    falling = np.where(bits >> 31, bits, ~bits & np.uint32(0x7FFFFFFF))
    order = np.argsort(i.astype(np.uint64) << np.uint64(32) | falling)
    tied = (i[order][1:] == i[order][:-1]) & (score[order][1:] == score[order][:-1])
    if tied.any():
        some = np.unique(j[order][np.append(tied, False) | np.append(False, tied)])
        rank = np.zeros(len(names), np.int64)
        rank[some[pc.sort_indices(names.take(pa.array(some))).to_numpy()]] = np.arange(len(some))
        order = np.lexsort((rank[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < most[i]
    return i[keep], j[keep], score[keep]


def _search_groups(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, radius: np.ndarray, part: float, k: int) -> Iterator[pa.RecordBatch]:
    """(key, copied, hits): rows come by group and share, in each the group's own blocks first, then pieces of other lists in reach."""
    at, group = None, None
    for b in batches:
        rows, asks = b.column(4), b.column(5)
        for n, (g, share, where, block) in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)))):
            if (g, share) != at:
                if group:
                    yield group.result()
                at, group = (g, share), _Group(share == 0, centroids, radius, part, k)
            if asks[n].is_valid:
                group.ask((where, block), rows[n].as_buffer().to_pybytes(), asks[n].as_buffer().to_pybytes())  # outlive the batch
                continue
            if not group.begun:
                group.begin()
            group.search(where, _columns(rows[n].as_buffer()), block)
    if group:
        yield group.result()


def cells_of(centroids: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Each list's cell: lists that lie near to each other, of at most ``most`` members in all unless one list has more."""
    cell, made, left = np.zeros(len(centroids), int), 0, [np.arange(len(centroids))]
    while left:
        at = left.pop()
        if len(at) == 1 or size[at].sum() <= most:
            cell[at] = made
            made += 1
            continue
        x = centroids[at] - centroids[at].mean(axis=0)
        at = at[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
        half = np.searchsorted(np.cumsum(size[at]), size[at].sum() / 2) + 1
        half = int(np.clip(half, 1, len(at) - 1))
        left += [at[:half], at[half:]]
    return cell


def _lists_frame(spark: SparkSession, **columns: np.ndarray) -> DataFrame:
    """(list, ...) for broadcast joins; at most `LISTS` rows and some."""
    rows = [(i, *(int(x) for x in values)) for i, values in enumerate(zip(*columns.values()))]
    return F.broadcast(spark.createDataFrame(rows, "list int, " + ", ".join(f"{c} int" for c in columns)))


def nearest(units: DataFrame, dim: int, k: int = K, list_size: int = LIST, recall: float = RECALL) -> DataFrame:
    """(key, hits): the k most similar other keys of each, best first, ties by key.

    ``units`` is as from `usable_vectors`. A key of equal vectors has the others of its class among its hits. Fewer
    than k other vectors give fewer hits; none, an empty list. ``recall`` is the share of neighbours that the searched
    lists must hold; 1 searches every list that may hold one. In a list the bounds of the codes hold with high
    probability. See the README for measured recall.
    """
    units = cut(units)
    sweep(units.sparkSession)
    classes = cut(units.groupBy("v").agg(F.min("key").alias("key"), F.count("*").alias("n")))
    n, most = classes.agg(F.count("*"), F.max("n")).first()
    spark = units.sparkSession
    hit_type = "array<struct<key: string, similarity: float>>"
    if not n:
        return spark.createDataFrame([], f"key string, hits {hit_type}")
    rows = classes.select("key", "v", F.lit(None).cast("array<string>").alias("copies"))
    if most > 1:
        # Classes of several keys: each stands for its first k + 1 keys as a hit, and all its keys get hits.
        copied = classes.filter("n > 1").select("v", F.col("key").alias("rep"))
        others = cut(hot_lookup_join(units, copied, ["v"], classes.select("v", "n")).filter("rep IS NOT NULL").select("rep", "key"))
        # The limit holds in each task before anything moves, so a large class is never in one place.
        place = F.row_number().over(Window.partitionBy("rep").orderBy("key"))
        heads = others.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("rep").agg(F.array_sort(F.collect_list("key")).alias("copies"))
        rows = classes.select("key", "v").join(counted(cut(heads.withColumnRenamed("rep", "key"))), "key", "left").select("key", "v", "copies")
    drop(units)
    lists = int(np.clip(-(-n // list_size), 1, LISTS))
    size = max(SAMPLE, PER_LIST * lists)
    share = min(1.0, 1.2 * size / n)
    drawn = classes.filter(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("v").limit(size)
    sample = np.frombuffer(b"".join(sorted(bytes(r.v) for r in drawn.collect())), np.float32).reshape(-1, dim)
    if not len(sample):
        sample = np.frombuffer(bytes(classes.first().v), np.float32).reshape(-1, dim)
    centroids = fit_lists(sample, lists)
    member = cut(rows.mapInArrow(partial(_assign, centroids=centroids), "key string, v binary, copies array<string>, list int, near float"))
    drop(classes)
    # At most as many rows as there are lists.
    sizes = {r[0]: (r[1], r[2]) for r in member.groupBy("list").agg(F.count("*"), F.min("near")).collect()}
    radius = np.array([_angle(sizes[i][1]) if i in sizes else -np.inf for i in range(len(centroids))])
    members = np.array([sizes.get(i, (0, 0))[0] for i in range(len(centroids))])
    blocks = np.maximum(1, -(-members // BLOCK))
    cell = cells_of(centroids, members, min(QUERIES, max(-(-n // GROUPS), list_size)))
    cells = int(cell.max()) + 1
    split = member.join(_lists_frame(spark, blocks=blocks, cell=cell), "list").select("key", "v", "copies", "list", "cell", F.pmod(F.xxhash64("key"), "blocks").cast("int").alias("block"))
    own = partial(_own_list, centroids=centroids, k=k, cells=cells, blocks=max(1, QUERIES // BLOCK))
    packed = cut(split.groupBy("list", "block").applyInArrow(lambda g: own(g), _PACKED_SQL))
    share = min(1.0, 1.2 * CALIBRATION / n)
    asking = packed.mapInArrow(partial(_draw, dim=dim, k=k, share=share), "v binary, floor float, own int").limit(CALIBRATION).collect() if recall < 1 else []
    part = reach_part(asking, member, centroids, radius, k, recall)
    drop(member)
    reach = partial(_reached, centroids=centroids, radius=radius, part=part, k=k)
    pairs = cut(packed.select("group", "list", "block", "piece", "n", "rows", "asks").mapInArrow(reach, "group long, list int").distinct())
    # What is sent to groups is many times the vectors, so it goes in waves, and the disk that a wave takes is free for the next.
    sent = pairs.join(_lists_frame(spark, members=members), "list").agg(F.sum("members")).first()[0]
    waves = -(-sent // max(WAVE * n, LEAST_WAVE))
    groups = -(-(pairs.agg(F.max("group")).first()[0] + 1) // waves)
    shares = min(lists, -(-2 * spark.sparkContext.defaultParallelism // groups))  # tasks of a group, so that few groups keep all cores busy
    run = partial(_search_groups, centroids=centroids, radius=radius, part=part, k=k)
    found = []
    for wave in range(waves):
        asked = cut(pairs.filter(F.pmod("group", F.lit(waves)) == wave).select(F.col("group").alias("at"), "list"))
        own = F.col("at") == F.col("group")
        pieces = packed.join(counted(asked), "list").withColumn("asks", F.when(own, F.col("asks")))
        pieces = pieces.withColumn("share", F.explode(F.when(own, F.sequence(F.lit(0), F.lit(shares - 1))).otherwise(F.array(F.pmod("list", F.lit(shares))))))
        placed = pieces.repartitionById(groups * shares, (F.floor(F.col("at") / waves) * shares + F.col("share")).cast("int"))
        ordered = placed.sortWithinPartitions("at", "share", F.col("asks").isNull(), "list", "block", "piece").select("at", "share", "list", "block", "rows", "asks")
        best = cut(ordered.mapInArrow(run, f"key string, copied boolean, hits {hit_type}"))
        if shares > 1:
            far = F.transform(F.flatten(F.collect_list("hits")), lambda h: F.struct((-h["similarity"]).alias("far"), h["key"].alias("key")))
            hits = best.groupBy("key").agg(F.max("copied").alias("copied"), F.array_sort(far).alias("hits"))
            hits = hits.withColumn("hits", F.slice("hits", F.lit(1), F.lit(k) + F.col("copied").cast("int")))
            whole = cut(hits.withColumn("hits", F.transform("hits", lambda h: F.struct(h["key"].alias("key"), (-h["far"]).alias("similarity")))))
            drop(best)
            best = whole
        found.append(best)
        drop(asked)
    drop(packed, pairs)
    merged = reduce(DataFrame.unionByName, found)
    if most == 1:
        return merged.select("key", "hits")
    wide = hot_lookup_join(others, merged.filter("copied").select(F.col("key").alias("rep"), "hits"), ["rep"], others.groupBy("rep").agg(F.count("*").alias("n")))
    wide = wide.select("key", F.slice(F.filter("hits", lambda h: h["key"] != F.col("key")), 1, k).alias("hits"))
    return merged.filter("NOT copied").select("key", "hits").unionByName(wide)


#: Components of a chunk's vector, and the similarity from which two chunks count as found.
DIMENSION, FOUND = 48, 0.97


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    return nearest(usable_vectors(table(spark, d, "vectors"), "chunk_id", "vector", DIMENSION), DIMENSION)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks of at least 0.97 among the 10 nearest of each."""
    h = _nearest(spark, d).select("key", F.explode("hits").alias("h")).filter(F.col("h.similarity") >= FOUND - 1e-7)
    return h.select(F.least("key", "h.key").alias("chunk_id_a"), F.greatest("key", "h.key").alias("chunk_id_b")).distinct()


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar chunks of every chunk, with rank and similarity."""
    return _nearest(spark, d).select(F.col("key").alias("chunk_id"), F.posexplode("hits").alias("p", "h")).select(
        "chunk_id", (F.col("p") + 1).alias("rank"), F.col("h.key").alias("neighbor_id"), F.round("h.similarity", 6).alias("similarity")
    )

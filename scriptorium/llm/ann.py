"""Nearest neighbours (largest inner products) by collision counting over single projections, and an exact check.

Vectors are indexed in blocks, and in a block by classes of like norm.  For each
of PROJECTIONS random directions an index has its vectors sorted by that one
projection, in CELLS runs of equal length; a vector is known by the run it is in.
A query opens a window around its own projection in every sorted array and
counts, for each vector, the windows that hold it.  Windows are widened by a
factor (virtual rehashing: each holds the one before) until FOUND vectors of the
index collide in at least the threshold of windows; all that do are verified by
their exact inner product.  The number verified is a constant, not a share.  Where
the FOUND-th and further vectors collide alike, all are verified.

What windows miss is made good by a check: the k-th score found is a bound, and
rows of the block that exceed it in single precision (for many queries at once)
are verified too, so the result is that of a scan.  Without the check the windows
find more than nine in ten.

Largest inner products become nearest neighbours by the usual lift: vectors are
scaled by the class' largest norm M and get one more component
sqrt(1 - |x|^2 / M^2), queries are normalised and get a zero.  Norms of a class
differ by RATIO at most, so the lift stays short whatever the spread of all norms;
classes come in falling order, and end where the largest norm cannot reach the
k-th best score.

Equal vectors of a block are one entry with all their ids, so copies are neither
cut nor counted again for each.  Every row is indexed, nothing is fitted but the
cells' limits and the first width (from rows of the index itself); the queries are
a stated set that meets all rows, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.frames import in_arrow, materialise

#: Random directions; share of them that a candidate collides in; runs of a sorted array.
PROJECTIONS, THRESHOLD, CELLS = 128, 0.6, 256
#: Vectors that collide often enough before windows stop growing, in each index.
FOUND = 1536
#: Rows of a block and queries of a part, about.
BLOCK_VECTORS, BLOCK_QUERIES = 16_384, 65_536
#: What windows grow by, and how far norms of a class lie apart.
GROW, RATIO = 1.06, 0.8
#: Widths that are looked up at once, and projections that are counted at once.
_WIDTHS, _AT_ONCE = 8, 16


def _directions(dims: int) -> np.ndarray:
    return np.random.default_rng(23).standard_normal((dims, PROJECTIONS))


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of rows whose key is not null and whose vector has only finite components and is not zero."""
    v = F.col(vector).cast("array<double>")
    wild = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return df.select(df[key].cast("bigint").alias("id"), v.alias("v")).filter("id is not null").filter(F.coalesce(~wild & some, F.lit(False)))


def _norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norms that do not overflow before their time."""
    most = np.abs(x).max(1, initial=0.0)
    y = x / most[:, None]
    return most * np.sqrt((y * y).sum(1))


def _at(queries: np.ndarray) -> np.ndarray:
    """Projections of queries' directions, lifted by a zero, [query, projection]."""
    d = _directions(queries.shape[1] + 1)
    return (queries / _norms(queries)[:, None]) @ d[:-1]


class Index:
    """Vectors of one class of norms, as places in sorted projections."""

    def __init__(self, vectors: np.ndarray, norms: np.ndarray):
        self.n = len(vectors)
        self.least_hits = int(np.ceil(THRESHOLD * PROJECTIONS))
        largest = norms.max()
        x = vectors / largest
        rest = np.sqrt(np.maximum(1 - (norms / largest) ** 2, 0))
        d = _directions(vectors.shape[1] + 1)
        projected = (x @ d[:-1] + rest[:, None] * d[-1]).T
        limits = np.sort(projected, 1)[:, (np.arange(1, CELLS) * self.n) // CELLS]
        self.limits = np.ascontiguousarray(limits)
        self.cell = np.stack([np.searchsorted(a, p, "right") for a, p in zip(self.limits, projected, strict=True)]).astype(np.uint8)
        self.offset, self.inside = np.empty((_AT_ONCE, self.n), np.uint8), np.empty((_AT_ONCE, self.n), bool)
        # about the width that FOUND entries collide at, for some of the entries
        reach = [np.partition(np.abs(projected - q[:, None]), self.least_hits - 1, 0)[self.least_hits - 1] for q in _at(vectors[:: max(1, self.n // 8)][:8])]
        self.width = float(np.quantile([np.partition(r, FOUND - 1)[FOUND - 1] for r in reach], 0.4)) / GROW

    def cells(self, at: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first cell, cells less one) of windows, [query, width, projection]."""
        lo, hi = (np.empty((PROJECTIONS, len(at), len(widths)), np.uint8) for _ in range(2))
        for j, limits in enumerate(self.limits):
            lo[j] = np.searchsorted(limits, at[:, j, None] - widths, "right")
            hi[j] = np.searchsorted(limits, at[:, j, None] + widths, "right")
        hi -= lo
        return np.ascontiguousarray(lo.transpose(1, 2, 0)), np.ascontiguousarray(hi.transpose(1, 2, 0))

    def windows(self, at: np.ndarray) -> list[np.ndarray]:
        """For each query the entries that collide with it often enough."""
        lo, size = self.cells(at, self.width * GROW ** np.arange(_WIDTHS))
        return [self._grown(at[q], lo[q], size[q]) for q in range(len(at))]

    def _grown(self, at: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        width = self.width
        while True:
            for a, s in zip(lo, size, strict=True):
                hits = np.zeros(self.n, np.uint8)
                for j in range(0, PROJECTIONS, _AT_ONCE):
                    np.subtract(self.cell[j : j + _AT_ONCE], a[j : j + _AT_ONCE, None], out=self.offset)
                    np.less_equal(self.offset, s[j : j + _AT_ONCE, None], out=self.inside)
                    hits += np.add.reduce(self.inside.view(np.uint8), 0, dtype=np.uint8)
                found = np.flatnonzero(hits >= self.least_hits)
                if len(found) >= FOUND or s.min() == CELLS - 1:
                    return found
                width *= GROW
            lo, size = (x[0] for x in self.cells(at[None, :], width * GROW ** np.arange(_WIDTHS)))


class Block:
    """A block's distinct vectors with their ids, in classes of falling norms."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        vectors = np.ascontiguousarray(vectors) + 0.0  # no negative zeros
        _, first, of = np.unique(vectors.view(f"V{8 * vectors.shape[1]}").ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((ids, of))
        self.ids, self.start = ids[order], np.searchsorted(of[order], np.arange(len(first) + 1))
        self.vectors = vectors[first]
        norms = _norms(self.vectors)
        step = np.floor(np.log(norms / norms.max()) / np.log(RATIO)).astype(np.int64)
        self.classes = []
        for c in np.unique(step):
            rows = np.flatnonzero(step == c)
            # few vectors are verified all: no window could leave one out
            largest = float(norms[rows].max())
            self.classes.append((largest, rows, (self.vectors[rows] / largest).astype(np.float32), Index(self.vectors[rows], norms[rows]) if len(rows) > FOUND else None))

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, check: bool = True) -> list[tuple[np.ndarray, ...]]:
        """For each query, (ids, scores, entries) of the k best candidates, ties by smaller id; rows of the query's id are none."""
        at, lengths = _at(queries), _norms(queries)
        *_, index = self.classes[0]
        first = index.windows(at) if index is not None else [None] * len(at)
        best = [self._found(int(i), v, a, n, k, f) for i, v, a, n, f in zip(query_ids, queries, at, lengths, first, strict=True)]
        return self._checked(query_ids, queries, lengths, k, best) if check else best

    def _ranked(self, rows: np.ndarray, query_id: int, query: np.ndarray, k: int, best: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, ...]:
        """(ids, scores, entries): the k best of `best` and of other entries `rows`."""
        score = (self.vectors[rows] * query).sum(1)
        size = np.minimum(self.start[rows + 1] - self.start[rows], k + 1)
        more = np.repeat(self.start[rows] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        new = self.ids[more], np.repeat(score, size), np.repeat(rows, size)
        ids, scores, entries = (np.concatenate(x) for x in zip(best, new, strict=True)) if best else new
        others = np.flatnonzero(ids != query_id)
        order = others[np.lexsort((ids[others], -scores[others]))[:k]]
        return ids[order], scores[order], entries[order]

    def _found(self, query_id: int, query: np.ndarray, at: np.ndarray, length: float, k: int, first: np.ndarray | None) -> tuple[np.ndarray, ...]:
        best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for step, (largest, rows, scaled, index) in enumerate(self.classes):
            bound = _bound(best[1], k)
            if largest * length * (1 + 1e-9) < bound:
                break
            if index is not None:
                hit = first if step == 0 else index.windows(at[None, :])[0]
                rows, scaled = rows[hit], scaled[hit]
            if len(rows) > k + 1:  # one may be the query itself
                # products in single precision keep all that can be among the best, whatever they round
                rough = scaled @ (query / length).astype(np.float32)
                rows = rows[rough >= max(float(np.partition(rough, -k - 1)[-k - 1]), bound / largest / length) - _ROUNDS]
            best = self._ranked(rows, query_id, query, k, best)
        return best

    def _checked(self, query_ids: np.ndarray, queries: np.ndarray, lengths: np.ndarray, k: int, best: list) -> list[tuple[np.ndarray, ...]]:
        """The best, and rows that windows have missed although their product reaches the k-th score."""
        bounds = np.array([_bound(x[1], k) for x in best])
        said = (queries / lengths[:, None]).astype(np.float32).T
        more: list[list[np.ndarray]] = [[] for _ in best]
        for largest, rows, scaled, index in self.classes:
            least = bounds / largest / lengths - _ROUNDS
            if index is None or (least > 1 + _ROUNDS).all():  # small classes were verified in full
                continue
            row, q = np.nonzero(scaled @ said >= least.astype(np.float32))
            order = np.argsort(q, kind="stable")
            for i, part in zip(*_groups(q[order]), strict=True):
                more[i].append(rows[row[order][part]])
        for i, m in enumerate(more):
            if len(missed := np.setdiff1d(np.concatenate(m), best[i][2])) if m else False:
                best[i] = self._ranked(missed, int(query_ids[i]), queries[i], k, best[i])
        return best


#: Products of vectors of norms up to 1 in single precision are off by less.
_ROUNDS = 1e-5


def _bound(scores: np.ndarray, k: int) -> float:
    return float(scores[-1]) if len(scores) == k and np.isfinite(scores[-1]) else -np.inf


def _groups(sorted_keys: np.ndarray) -> tuple[list[int], list[slice]]:
    """Keys, and where each stands."""
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return sorted_keys[first].tolist(), [slice(a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(sorted_keys)], strict=True)]


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def nearest_neighbours(df: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", check: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by `every`, k near ones by inner product among rows of other keys.

    Vectors that are null, zero or hold a null or non-finite component take no
    part, nor do those of other than the commonest length (of two as common, the
    smaller); rows of one key are each candidates and queries; a null key is
    neither; a product that overflows is infinite, or NaN and then last; fewer
    than k others give fewer rows; other columns play no part.  check: whether the
    windows' candidates are completed to the exact result.
    """
    spark = df.sparkSession
    rows = materialise(usable(df, key, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("asked")).orderBy(F.desc("n"), "d")
    about = lengths.first()
    if about is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.filter(F.size("v") == about.d)
    blocks = -(-about.n // BLOCK_VECTORS)
    # each block meets each part of the queries: (block, part) is one unit of work; few blocks have more parts, for more tasks
    asked_parts = max(1, -(-about.asked // BLOCK_QUERIES), min(-(-32 // blocks), about.asked // 256))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")
    part = F.pmod(F.xxhash64("row"), F.lit(asked_parts)).cast("int").alias("part")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    held = rows.select(block, every_of(asked_parts).alias("part"), F.lit(0).alias("role"), "id", "row", "v")
    asked = rows.filter(F.col("id") % every == 0).select(every_of(blocks).alias("block"), part, F.lit(1).alias("role"), "id", "row", "v")
    work = held.union(asked).repartition(int(blocks * asked_parts), "block", "part").sortWithinPartitions("block", "part", "role", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, index = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            b, p, role, i, row = (batch.column(c).to_numpy() for c in range(5))
            v = _matrix(batch.column(5))
            new = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (p[1:] != p[:-1]) | (role[1:] != role[:-1])]))
            for s, e in zip(new, [*new[1:], len(b)], strict=True):
                if (b[s], p[s]) != now:
                    now, ids, vectors, index = (b[s], p[s]), [], [], None
                if role[s] == 0:
                    ids.append(i[s:e])
                    vectors.append(v[s:e])
                    continue
                if index is None and ids:
                    index = Block(np.concatenate(ids), np.concatenate(vectors))
                if index is None:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    out = [x for q in range(s, e, 512) for x in index.nearest(i[q : min(q + 512, e)], v[q : min(q + 512, e)], k, check)]
                sizes = [len(x[0]) for x in out]
                yield pa.record_batch([pa.array(np.repeat(i[s:e], sizes)), pa.array(np.repeat(row[s:e], sizes)), pa.array(np.concatenate([x[0] for x in out])), pa.array(np.concatenate([x[1] for x in out]))], names=["query_id", "query_row", "vec_id", "score"])

    found = in_arrow(work, run, "query_id bigint, query_row bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").eqNullSafe(F.lit(float("nan"))), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""The best few of very many pairs: queries meet rows in NumPy blocks, and each task keeps a query's best alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.shipping import ship

#: Queries of one pass over the rows, rows of a block, rows of a task, about, and pairs that are looked at exactly at once.
QUERIES, BLOCK, ROWS, EXACT = 2048, 1024, 16384, 1 << 17
#: Items of one pass, and counts of a block, of shared words.
ITEMS, COUNTS = 2048, 1 << 21


class Best:
    """For each of n queries the k rows of least value, ties to the lesser key; rows come in batches of candidates."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.query, self.value, self.key = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        #: The k-th value of each query so far.
        self.last = np.full(n, np.inf)
        self.full = np.zeros(n, bool)

    def add(self, query: np.ndarray, value: np.ndarray, key: np.ndarray) -> None:
        if not len(query):
            return
        q, v, x = np.concatenate([self.query, query]), np.concatenate([self.value, value]), np.concatenate([self.key, key])
        order = np.lexsort((x, v, q))
        q, v, x = q[order], v[order], x[order]
        starts = np.searchsorted(q, np.arange(self.n))
        keep = np.arange(len(q)) - starts[q] < self.k
        self.query, self.value, self.key = q[keep], v[keep], x[keep]
        counts = np.bincount(self.query, minlength=self.n)
        self.full = counts >= self.k
        ends = np.cumsum(counts) - 1
        self.last[self.full] = self.value[ends[self.full]]


def _matrix(column: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, and which of them are whole (of that length, without nulls)."""
    out, whole = np.zeros((len(column), dims)), np.zeros(len(column), bool)
    flat, ends = column.flatten(), np.cumsum(np.nan_to_num(np.asarray(column.value_lengths().fill_null(0))).astype(np.int64))
    lengths = np.diff(np.concatenate([[0], ends]))
    if flat.null_count == 0 and (lengths == dims).all():
        return np.asarray(flat, dtype=np.float64).reshape(-1, dims), np.ones(len(column), bool)
    values = flat.to_pylist()
    for i, (end, n) in enumerate(zip(ends, lengths)):
        x = values[end - n : end]
        if n == dims and None not in x:
            out[i], whole[i] = x, True
    return out, whole


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str, query: str, k: int) -> DataFrame:
    """(query_key, key, distance): of each part of the vectors the k nearest to each query by L2, unrounded; all vectors' k nearest are among them.

    Every query meets every vector: products find which pairs may be among the
    best, and these are measured component by component.  A pair without a measure
    (nulls, another length) comes last.  Queries are taken QUERIES at a time, so
    memory does not grow with them, and the work is spread by vectors.
    """
    spark = vectors.sparkSession
    ship(spark)
    names = {f.name: f.dataType.simpleString() for f in [queries.schema[query_key], vectors.schema[key]]}
    dealt = vectors.select(key, vector).repartition(-(-vectors.count() // ROWS) or 1, key)
    out = None
    asked = queries.select(query_key, query).toArrow()
    for at in range(0, max(asked.num_rows, 1), QUERIES):
        part = asked.slice(at, QUERIES).combine_chunks()
        ids = np.asarray(part[query_key].to_pylist(), dtype=np.int64)
        lists = part[query].combine_chunks()
        lengths = [n for n in lists.value_lengths().to_pylist() if n]
        dims = max(set(lengths), key=lengths.count) if lengths else 1
        held = dealt.mapInArrow(_nearest_to(ids, *_matrix(lists, dims), k), f"{query_key} {names[query_key]}, {key} {names[key]}, distance double")
        out = held if out is None else out.union(held)
    return out


def _nearest_to(ids: np.ndarray, asked: np.ndarray, usable: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, norms = Best(len(ids), k), (asked * asked).sum(1)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                keys = np.asarray(piece.column(0), dtype=np.int64)
                rows, whole = _matrix(piece.column(1), asked.shape[1])
                own = (rows * rows).sum(1)
                near = norms[:, None] + own[None, :] - 2.0 * (asked @ rows.T)
                # products err by their terms' size, and values are rounded to 6 places before ties are told
                last = np.where(np.isfinite(best.last), (best.last + 2e-6) ** 2, np.inf)
                slack = 1e-9 * (norms[:, None] + own[None, :])
                may = (near <= last[:, None] + slack) | ~np.isfinite(near)
                if not best.full.all() and len(keys) > 4 * k:  # before there is a k-th value, this block's own is a bound
                    kth = np.sqrt(np.maximum(np.partition(np.where(whole[None, :], near + slack, np.inf), k - 1, axis=1)[:, k - 1], 0.0))
                    may &= (near <= ((kth + 2e-6) ** 2)[:, None] + 2 * slack) | ~np.isfinite(near) | ~np.isfinite(kth)[:, None]
                may |= ~(whole[None, :] & usable[:, None]) & ~np.isfinite(best.last)[:, None]
                q, r = np.nonzero(may)
                for i in range(0, len(q), EXACT):
                    a, b = q[i : i + EXACT], r[i : i + EXACT]
                    d = asked[a] - rows[b]
                    value = np.sqrt(np.einsum("ij,ij->i", d, d))
                    best.add(a, np.where(whole[b] & usable[a], np.floor(value * 1e6 + 0.5) / 1e6, np.inf), keys[b])
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.query]), pa.array(best.key), pa.array(best.value, mask=~np.isfinite(best.value))], ["q", "x", "d"])

    return run


def most_shared(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, shared): of each part of the documents the k that share most words with each item, ties to the lesser doc_id.

    docs: (doc_id, words), items: (item_id, words), words once each.  A document's
    words meet the items that have them in its task, so no pair is ever shuffled.
    """
    ship(docs.sparkSession)
    held = items.collect()
    out = None
    for at in range(0, max(len(held), 1), ITEMS):
        part = held[at : at + ITEMS]
        ids = sorted({r.item_id for r in part if r.item_id is not None})
        place = {x: i for i, x in enumerate(ids)}
        having: dict[str, list[int]] = {}
        for r in part:
            for t in r.words or () if r.item_id is not None else ():
                having.setdefault(t, []).append(place[r.item_id])
        found = docs.select("doc_id", "words").mapInArrow(_most_shared(np.asarray(ids, dtype=np.int64), having, k), "item_id long, doc_id long, shared long")
        out = found if out is None else out.union(found)
    return out


def _most_shared(ids: np.ndarray, having: dict[str, list[int]], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(ids)
        best, rows = Best(n, k), max(1, COUNTS // max(n, 1))
        lists = [np.asarray(x, dtype=np.int64) for x in having.values()]
        many = np.asarray([len(x) for x in lists], dtype=np.int64)
        begins, flat = np.concatenate([[0], np.cumsum(many)[:-1]]) if lists else np.empty(0, np.int64), np.concatenate(lists) if lists else np.empty(0, np.int64)
        terms = pa.array(list(having), pa.string())
        for batch in batches:
            for start in range(0, batch.num_rows if n else 0, rows):
                piece = batch.slice(start, rows)
                keys, words = np.asarray(piece.column(0), dtype=np.int64), piece.column(1)
                sizes = np.nan_to_num(np.asarray(words.value_lengths().fill_null(0))).astype(np.int64)
                doc = np.repeat(np.arange(len(keys)), sizes)
                term = pa.compute.index_in(words.flatten(), value_set=terms)
                known = np.asarray(term.is_valid())
                doc, term = doc[known], np.asarray(term.drop_null(), dtype=np.int64)
                count = np.zeros(len(keys) * n, dtype=np.int64)
                for i in range(0, len(doc), 1 << 14):  # a few items for each word
                    d, t = doc[i : i + (1 << 14)], term[i : i + (1 << 14)]
                    each = many[t]
                    offset = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    where = np.repeat(d * n, each) + flat[np.repeat(begins[t], each) + offset]
                    low = int(where.min()) if len(where) else 0
                    got = np.bincount(where - low) if len(where) else np.empty(0, np.int64)
                    count[low : low + len(got)] += got
                count = count.reshape(len(keys), n)
                d, q = np.nonzero((count > 0) & (-count <= best.last[None, :]))
                best.add(q, -count[d, q].astype(float), keys[d])
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.query]), pa.array(best.key), pa.array((-best.value).astype(np.int64))], ["item_id", "doc_id", "shared"])

    return run

"""Packing along a space-filling curve.

Each document's ids are hashed into a vector, projected to few dimensions and
given a Hilbert key; documents are range-sorted by the key and laid end to end,
and the line is cut into sequences.  Neighbours on the curve, and so documents
of like content, share sequences; only the line's last sequence is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import textkit as tk
from scriptorium.llm import tokens
from scriptorium.llm.frames import in_arrow, materialise

#: Buckets of the hashed vector, dimensions of the curve, bits of each.
BUCKETS, DIMS, BITS = 1024, 4, 12


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points [n, dims] of `bits` bits a dimension."""
    x = x.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:  # undo the rotations of each level, from the top one
        low = q - one
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= one
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > one:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - one), flip)
        q >>= one
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def curve_points(vectors: np.ndarray) -> np.ndarray:
    """Integer points of hashed vectors: seeded Gaussian projections of their directions, by the normal distribution's steps."""
    plane = np.random.default_rng(7).standard_normal((vectors.shape[1], DIMS))
    weights = np.sqrt(vectors)
    norm = np.sqrt((weights * weights).sum(1, keepdims=True))
    y = weights / np.maximum(norm, 1e-12) @ plane
    share = 1 / (1 + np.exp(-1.702 * y))
    return np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def tokenised(df: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text", id_bytes: int = 2) -> DataFrame:
    """(uid, doc_id, curve, n, ids) of each row; ids: little-endian, of id_bytes bytes; an id that does not fit is an error."""
    kind = f"<u{id_bytes}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, uid = tokens.encoder(vocabulary, "byte"), TaskContext.get().partitionId() << 36
        for batch in batches:
            raw, offsets = tk.utf8(batch.column(1))
            parts: list[np.ndarray] = []
            vector = np.zeros((1, BUCKETS))
            for a, b, ids, sizes, done in encoder.rows_ended(raw, offsets, end_id):
                rows = b - a
                bucket = (ids * np.uint32(2654435761)) >> np.uint32(22)
                add = np.bincount(np.repeat(np.arange(rows) * BUCKETS, sizes) + bucket, minlength=rows * BUCKETS).reshape(rows, BUCKETS)
                vector = vector + add
                if len(ids) and int(ids.max()) >> 8 * id_bytes:
                    raise ValueError(f"id {int(ids.max())} in {id_bytes} bytes: set id_bytes=4")
                parts.append(ids.astype(kind))
                if not done:
                    continue
                ids = np.concatenate(parts)
                n = sizes.astype(np.int64)
                n[0] += len(ids) - int(n.sum())
                curve = hilbert_keys(curve_points(vector), BITS)
                cuts = np.concatenate([[0], np.cumsum(n)]) * id_bytes
                blob = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(ids.tobytes())])
                yield pa.record_batch([pa.array(np.arange(uid, uid + rows)), batch.column(0).slice(a, rows), pa.array(curve), pa.array(n), blob.cast(pa.binary())], names=["uid", "doc_id", "curve", "n", "ids"])
                uid += rows
                parts, vector = [], np.zeros((1, BUCKETS))

    docs = df.select(df[key].cast("bigint").alias("doc_id"), df[text].cast("string").alias("text"))
    return in_arrow(docs, run, "uid bigint, doc_id bigint, curve bigint, n bigint, ids binary")


def line_starts(rows: DataFrame) -> DataFrame:
    """(uid, place): ids before each row along the curve.

    Rows are range-sorted; places are counted within partitions, and partitions'
    totals, a row for each, are summed over.
    """
    ordered = rows.select("curve", "uid", "n").repartitionByRange("curve", "uid").sortWithinPartitions("curve", "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            upto = at + np.cumsum(n)
            yield pa.record_batch([batch.column(1), pa.array(np.full(len(n), part), pa.int32()), pa.array(upto - n), pa.array(n)], names=["uid", "part", "place", "n"])
            at = int(upto[-1]) if len(n) else at

    local = materialise(in_arrow(ordered, run, "uid bigint, part int, place bigint, n bigint"), "curve")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = local.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return local.join(F.broadcast(parts), "part").select("uid", (F.col("place") + F.col("ahead")).alias("place"))  # a row for each partition


def pack(df: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text", with_ids: bool = False, id_bytes: int = 2) -> DataFrame:
    """Pieces of packed sequences: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Each id of each row lies in one piece; sequences are full but for the last.
    A null or empty text is its end id; rows of one doc_id are packed each by
    themselves; other columns play no part; an empty table gives no rows.
    with_ids adds the pieces' ids as little-endian integers of id_bytes bytes, 2 or
    4; vocabularies of more than 65,536 ids need 4.
    """
    kind = f"<u{id_bytes}"
    rows = materialise(tokenised(df, vocabulary, end_id, key, text, id_bytes), "ids-z")
    placed = rows.select("uid", "doc_id", "ids").join(line_starts(rows), "uid")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column(2).to_numpy()
            blobs = batch.column(1)
            blobs = [memoryview(blobs[k].as_buffer()) for k in range(len(blobs))]
            n = np.array([len(x) // id_bytes for x in blobs], np.int64)
            first, last = place // length, (place + n - 1) // length
            pieces = last - first + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            seq = tk.ranges(first, pieces)
            lo = np.maximum(place[doc], seq * length)
            hi = np.minimum(place[doc] + n[doc], (seq + 1) * length)
            start = lo - place[doc]
            crc, ids = np.zeros(len(doc), np.int64), []
            for k, (d, s, e) in enumerate(zip(doc.tolist(), start.tolist(), (start + hi - lo).tolist(), strict=True)):
                x = np.frombuffer(blobs[d], kind, e - s, id_bytes * s)
                crc[k] = zlib.crc32(x.astype("<u4").tobytes())
                if with_ids:
                    ids.append(x.tobytes())
            cols = [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(hi - lo), pa.array(crc), pa.array(n[doc]), pa.array(seq), pa.array(lo - seq * length)]
            yield pa.record_batch(cols + [pa.array(ids, pa.binary())] * with_ids, names=names)

    return in_arrow(placed.select("doc_id", "ids", "place"), run, ", ".join(f"{c} bigint" for c in names if c != "ids") + ", ids binary" * with_ids)

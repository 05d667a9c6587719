"""Benchmark decontamination by latent semantic retrieval.

1. One pass over all documents counts, for hashed words, the passages that hold
   them, and sketches the passages' co-occurrence matrix (passages are runs of
   PASSAGE words): each partition adds up C'(C Omega) for its counts C and the
   seeded test matrix Omega.  The partitions' sums (words x rank, whatever the
   corpus' size) are added up, scaled by the inverse passage frequencies, and
   give the leading right singular vectors and values of the TF-IDF passages (the
   randomised SVD's single-pass form for A'A).
2. A second pass slides windows of about each benchmark item's length over every
   document and takes those that hold enough of an item's rarest words: as many as
   step 3 cannot do without.  A window's cosine with the item, projected on those
   vectors, is given with a leak; it rejects none, as a paraphrase that passes
   step 3 can have a low one.
3. Around each such window the longest common subsequence of words with the item
   is measured, over the item and over its answer (its last quarter); enough of
   both is a leak, so paraphrases that keep most words in order are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import textkit as tk
from scriptorium.llm import tokens
from scriptorium.llm.frames import in_arrow
from scriptorium.llm.toxicity import _lower_table

#: Hashed words, rank, columns of the sketch, words of a passage.
WORDS, RANK, WIDTH, PASSAGE = 8192, 24, 24, 48
#: Least shares of an item's and its answer's words that a leak has in order.
COMMON, ANSWER = 0.6, 0.5
#: An item's anchors are its rarest words, as many as a leak may lack and this share of the item more.
ANCHORS = 0.2
#: Items are compared in blocks of so many, each in a pass of its own.
MOST_ITEMS = 20_000
#: An item longer than this is compared in parts.
PART_WORDS = 96
_SIZES = (6, 9, 13, 20, 30, 45, 67, 100)
_BLOCK = 1 << 16


def words_of(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(first row, word hashes, rows, places in the row, words that an earlier block had) of runs of letters and numbers, lower case.

    A row of many words comes in blocks that overlap by two of the largest windows.
    """
    keep = 2 * _SIZES[-1] + PART_WORDS
    for a, b in tk.row_slices(offsets):
        tail, seen = np.zeros(0, np.uint64), 0
        for r, o in tk.word_chunks(raw, offsets, a, b):
            cp, pos = tk.code_points(r)
            low = _lower_table()[cp] if not len(cp) or cp.max() < 65536 else np.where(cp < 65536, _lower_table()[np.minimum(cp, 65535)], cp)
            inside = tokens.classes()[cp] <= tokens._NUMBER
            starts = np.searchsorted(pos, o, "left")
            edge = np.zeros(len(cp) + 1, bool)
            edge[1:-1] = inside[1:] != inside[:-1]
            edge[starts] = True
            mark = np.flatnonzero(edge)
            begin, end = mark[:-1], mark[1:]
            here = inside[begin] if len(cp) else np.zeros(0, bool)
            begin, end = begin[here], end[here]
            h = tk.segment_hash(tk.prefix_hash(low), begin, end)
            row = np.searchsorted(starts, begin, "right") - 1
            if b - a > 1:
                n = np.bincount(row, minlength=b - a)
                yield a, h, row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), 0
                continue
            for s in range(0, max(len(h), 1), _BLOCK):
                part = np.concatenate([tail, h[s : s + _BLOCK]])
                had = len(tail)
                yield a, part, np.zeros(len(part), np.int64), np.arange(seen - had, seen - had + len(part)), had
                seen += len(part) - had
                tail = part[-keep:]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 13)).astype(np.int64)


def _test_matrix() -> np.ndarray:
    return np.random.default_rng(31).standard_normal((WORDS, WIDTH)).astype(np.float32)


@dataclass
class Latent:
    """word_vectors: for each hashed word, its weight times its row of singular vectors, by singular values; share: of passages that hold it."""

    word_vectors: np.ndarray
    values: np.ndarray
    passages: int
    share: np.ndarray


def latent_space(docs: DataFrame) -> Latent:
    """The latent space of rows (doc_id, text): step 1."""
    chunks = 16
    height = WORDS // chunks

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega = _test_matrix()
        total, found, passages = np.zeros((WORDS, WIDTH)), np.zeros(WORDS), 0
        for batch in batches:
            raw, offsets = tk.utf8(batch.column(1))
            for _, h, row, place, had in words_of(raw, offsets):
                h, row, place = h[had:], row[had:], place[had:]
                if not len(h):
                    continue
                w, group = _bucket(h), row * (1 << 32) + place // PASSAGE
                head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                number = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(h))))
                y = np.add.reduceat(omega[w], head, axis=0)
                order = np.argsort(w.astype(np.uint16), kind="stable")
                sorted_w = w[order]
                first = np.flatnonzero(np.concatenate([[True], sorted_w[1:] != sorted_w[:-1]]))
                total[sorted_w[first]] += np.add.reduceat(y[number[order]], first, axis=0)
                pairs = sorted_w * len(head) + number[order]
                new = np.concatenate([[True], pairs[1:] != pairs[:-1]])  # equal pairs stand together: both sorts are stable
                found += np.bincount(sorted_w[new], minlength=WORDS)
                passages += len(head)
        for k in range(chunks):
            s = slice(k * height, (k + 1) * height)
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([total[s].astype("<f4").tobytes()]), pa.array([found[s].astype("<f8").tobytes()]), pa.array([passages], pa.int64())], names=["chunk", "total", "found", "passages"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for k, t, f, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = sums.setdefault(k, [np.zeros(height * WIDTH), np.zeros(height), 0])
                held[0] += np.frombuffer(t, "<f4")
                held[1] += np.frombuffer(f, "<f8")
                held[2] += p
        for k, (t, f, p) in sums.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([t.astype("<f4").tobytes()]), pa.array([f.astype("<f8").tobytes()]), pa.array([p], pa.int64())], names=["chunk", "total", "found", "passages"])

    schema = "chunk int, total binary, found binary, passages bigint"
    parts = in_arrow(docs, sketch, schema)
    # in two steps, so that no task adds up more than some partitions' sums
    parts = in_arrow(parts.repartition("chunk", F.pmod(F.monotonically_increasing_id(), F.lit(8))), add, schema)
    got = in_arrow(parts.repartition(chunks, "chunk"), add, schema).collect()  # WORDS x WIDTH numbers
    z, found, passages = np.zeros((WORDS, WIDTH)), np.zeros(WORDS), 0
    for r in got:
        s = slice(r.chunk * height, (r.chunk + 1) * height)
        z[s], found[s], passages = np.frombuffer(r.total, "<f4").reshape(height, WIDTH), np.frombuffer(r.found, "<f8"), r.passages
    return _decomposed(z, found, passages)


def _decomposed(z: np.ndarray, found: np.ndarray, passages: int) -> Latent:
    """Singular vectors of the weighted passages from z = M Omega, with M = C'C, by M = Z (Omega'Z)^-1 Z'."""
    weight = np.log((passages + 1) / (found + 1)) + 0.1
    core = _test_matrix().astype(float).T @ z
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    keep = values > max(values.max(initial=0.0), 1e-12) * 1e-7
    half = (z * weight[:, None]) @ (vectors[:, keep] / np.sqrt(values[keep]))
    if not half.size:
        return Latent(np.zeros((WORDS, 1), np.float32), np.zeros(1), passages, found / max(passages, 1))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    u, s = u[:, :RANK], s[:RANK]  # the columns beyond the rank only make the leading ones exact
    return Latent((u * weight[:, None] / np.maximum(s, s[0] * 1e-4)).astype(np.float32), s, passages, found / max(passages, 1))


class Items:
    """Benchmark items, in parts, sorted into window sizes."""

    def __init__(self, rows: list[tuple[int, str]], latent: Latent):
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        for item, text in rows:
            raw, offsets = tk.utf8(pa.array([text]))
            h = np.concatenate([x[1][x[4] :] for x in words_of(raw, offsets)] or [np.zeros(0, np.uint64)])
            n = -(-len(h) // PART_WORDS)
            for k in range(n):
                self.ids.append(item)
                self.words.append(h[len(h) * k // n : len(h) * (k + 1) // n])
        size = np.array([len(w) for w in self.words])
        self.size = np.array([min(_SIZES, key=lambda s: abs(np.log(s / n))) for n in size]) if len(size) else size
        v = np.stack([latent.word_vectors[_bucket(w)].sum(0) for w in self.words]) if self.words else np.zeros((0, latent.word_vectors.shape[1]))
        self.vectors = (v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)).astype(np.float32)
        self.masks = [{} for _ in self.words]
        for masks, w in zip(self.masks, self.words, strict=True):
            for k, x in enumerate(w.tolist()):
                masks[x] = masks.get(x, 0) | 1 << k

        # anchors: (word, item) pairs, by word; of n words a leak may lack n - least in order, so it holds all other anchors
        self.needed = np.zeros(len(self.words), np.int64)
        pairs = set()
        for k, w in enumerate(self.words):
            n, least = len(w), int(np.ceil(COMMON * len(w) - 1e-9))
            many = min(n, n - least + max(1, int(np.ceil(ANCHORS * n))))
            self.needed[k] = many - (n - least)
            pairs.update((x, k) for x in w[np.argsort(latent.share[_bucket(w)], kind="stable")[:many]].tolist())
        pairs = sorted(pairs)
        self.anchor_words = np.array([p[0] for p in pairs], np.uint64)
        self.anchor_items = np.array([p[1] for p in pairs], np.int64)

    def anchored(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) of each anchor word of an item among h."""
        lo, hi = np.searchsorted(self.anchor_words, h, "left"), np.searchsorted(self.anchor_words, h, "right")
        at = np.flatnonzero(hi > lo)
        return np.repeat(at, hi[at] - lo[at]), self.anchor_items[tk.ranges(lo[at], hi[at] - lo[at])]

    def common(self, k: int, window: list[int]) -> tuple[float, float]:
        """Shares of item k's words, and of its answer's, in the longest common subsequence with a window; by bits of one integer."""
        masks, n = self.masks[k], len(self.words[k])
        hits = [masks[x] for x in window if x in masks]
        if len(hits) < COMMON * n:
            return 0.0, 0.0
        full = v = (1 << n) - 1
        for m in hits:
            u = v & m
            v = ((v + u) | (v - u)) & full
        answer = -(-n // 4)
        return 1 - v.bit_count() / n, 1 - (v >> n - answer).bit_count() / answer


def leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, common, answer, cosine) of each document and benchmark item that it holds.

    Null and empty texts and items, and items without words, leak nothing; rows
    of one key count as one document; a null key is a key; other columns play no
    part.
    """
    spark = df.sparkSession
    docs = df.select(df[key].cast("bigint").alias("doc_id"), df[text].cast("string").alias("text"))
    asked = benchmark.select(benchmark[item].cast("bigint").alias("item_id"), benchmark[item_text].cast("string").alias("text")).filter("text is not null and item_id is not null")
    blocks = max(1, -(-asked.count() // MOST_ITEMS))
    latent = latent_space(docs)
    schema = "doc_id bigint, item_id bigint, common double, answer double, cosine double"
    out = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about MOST_ITEMS, whatever the benchmark's size
        found = in_arrow(docs, _search(Items([(r.item_id, r.text) for r in rows], latent), latent), schema)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], schema)
    best = out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("common", "answer", "cosine"), F.struct("common", "answer", "cosine")).alias("x"))
    return best.select(F.col("doc_id").alias(key), "item_id", "x.common", "x.answer", "x.cosine")


def _search(items: Items, latent: Latent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0)
            raw, offsets = tk.utf8(batch.column(1))
            found: dict[tuple[int, int], tuple[float, float, float]] = {}
            for a, h, row, _, _ in words_of(raw, offsets):
                if not len(h) or not len(items.ids):
                    continue
                w, n = _bucket(h), np.bincount(row)
                first = np.cumsum(n) - n
                place, anchor_of = items.anchored(h)
                for size in np.unique(items.size).tolist():
                    which = np.flatnonzero(items.size == size)
                    step = max(1, size // 4)
                    count = np.maximum(-(-(n - size) // step), 0) + (n > 0)
                    starts = np.cumsum(count) - count
                    begin = tk.ranges(np.zeros(len(n), np.int64), count) * step
                    of = np.repeat(np.arange(len(n)), count)
                    end = first[of] + np.minimum(begin + size, n[of])
                    begin = first[of] + np.maximum(np.minimum(begin, n[of] - size), 0)
                    number = np.full(len(items.ids), -1)
                    number[which] = np.arange(len(which))
                    half = size // 2
                    mine = number[anchor_of] >= 0
                    q, k = place[mine], number[anchor_of[mine]]
                    r = row[q]
                    q = q - first[r]
                    # of windows and the half of one on each side that is compared with them; the last begins early
                    low = np.clip(-(-(q - half - size + 1) // step), 0, count[r] - 1)
                    high = np.where(q >= n[r] - size - half, count[r] - 1, np.clip((q + half) // step, 0, count[r] - 1))
                    lead, many = starts[r] + low, high - low + 1
                    window = np.repeat(lead, many) + tk.ranges(np.zeros(len(q), np.int64), many)
                    k = np.repeat(k, many)
                    met = [np.zeros(0, np.int64)]
                    for s in range(0, len(which), 512):
                        part = which[s : s + 512]
                        near = (k >= s) & (k < s + 512)
                        held = np.bincount(window[near] * len(part) + k[near] - s, minlength=len(begin) * len(part)).reshape(len(begin), len(part))
                        i, j = np.nonzero(held >= items.needed[part])
                        met.append(i * len(which) + s + j)
                    for pair in np.unique(np.concatenate(met)).tolist():
                        i, j = pair // len(which), int(which[pair % len(which)])
                        d = int(of[i])
                        lo, hi = max(int(begin[i]) - half, int(first[d])), min(int(end[i]) + half, int(first[d] + n[d]))
                        common, answer = items.common(j, h[lo:hi].tolist())
                        if common >= COMMON and answer >= ANSWER:
                            v = latent.word_vectors[w[begin[i] : end[i]]].sum(0)
                            c = float(v @ items.vectors[j]) / max(float(np.sqrt(v @ v)), 1e-9)
                            found[a + d, items.ids[j]] = max(found.get((a + d, items.ids[j]), (0.0, 0.0, 0.0)), (common, answer, c))
            rows = list(found)
            cols = [pa.array([found[p][k] for p in rows], pa.float64()) for k in range(3)]
            yield pa.record_batch([docs.take(pa.array([p[0] for p in rows], pa.int64())), pa.array([p[1] for p in rows], pa.int64()), *cols], names=["doc_id", "item_id", "common", "answer", "cosine"])

    return run

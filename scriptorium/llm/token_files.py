"""Token-id files: ids of documents in range-coded blocks, in order of the documents' ids.

A file is a Parquet container written by Spark's committed writer (so a lost
executor or a second attempt leaves no half file) with one row per frame:

    file_no, frame_no   order of the frames
    n_tokens            ids of the frame
    doc_ids, sizes      the frame's documents and their numbers of ids
    blocks              range-coded blocks (see range_coder), end to end

A frame holds whole documents; a long document's ids span several blocks of its
frame, so neither writer nor reader holds more than a block and a document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm import range_coder as rc
from scriptorium.llm import textkit as tk
from scriptorium.llm import tokens
from scriptorium.llm.frames import checked_broadcast, in_arrow, materialise

FRAME_SCHEMA = "file_no int, frame_no int, n_tokens bigint, doc_ids array<bigint>, sizes array<bigint>, blocks binary"


class _FrameWriter:
    def __init__(self, alphabet: int, file_no: int):
        self.alphabet, self.file_no, self.frame_no = alphabet, file_no, 0
        self.ids: list[np.ndarray] = []
        self.held = 0
        self._clear()

    def _clear(self) -> None:
        self.docs: list = []
        self.sizes: list[int] = []
        self.blocks: list[bytes] = []
        self.coded = 0

    def add(self, ids: np.ndarray) -> None:
        while self.held + len(ids) >= rc.BLOCK_IDS:
            k = rc.BLOCK_IDS - self.held
            self.ids.append(ids[:k])
            self._block()
            ids = ids[k:]
        self.ids.append(ids)
        self.held += len(ids)

    def _block(self) -> None:
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        if len(ids):
            self.blocks.append(rc.encode_block(ids, self.alphabet))
            self.coded += len(ids)
        self.ids, self.held = [], 0

    def full(self) -> bool:
        return self.coded > 0

    def frame(self) -> pa.RecordBatch:
        self._block()
        row = {"file_no": [self.file_no], "frame_no": [self.frame_no], "n_tokens": [self.coded], "doc_ids": [self.docs], "sizes": [self.sizes], "blocks": [b"".join(self.blocks)]}
        self.frame_no += 1
        self._clear()
        return pa.record_batch(row, schema=pa.schema([("file_no", pa.int32()), ("frame_no", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("blocks", pa.binary())]))


def encode_frames(df: DataFrame, vocabulary: str, alphabet: int, end_id: int = 1, kind: str = "word", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Frames of df's documents in ascending order of (key, text's hash); see the module.

    Range partitions are cut on both columns, so many rows of one key spread.
    """
    docs = df.select(df[key].cast("bigint").alias("doc_id"), df[text].cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = docs.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _FrameWriter(alphabet, TaskContext.get().partitionId())
        encoder = tokens.encoder(vocabulary, kind)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            raw, offsets = tk.utf8(batch.column(1))
            open_ = 0
            for a, b, ids, sizes, done in encoder.rows_ended(raw, offsets, end_id):
                out.add(ids)
                if not done:
                    open_ += int(sizes[0])
                    continue
                sizes = sizes.tolist()
                sizes[0] += open_
                open_ = 0
                out.docs += doc_ids[a:b]
                out.sizes += sizes
                if out.full():
                    yield out.frame()
        if out.docs:
            yield out.frame()

    return in_arrow(ordered.select("doc_id", "text"), run, FRAME_SCHEMA)


def decode_frames(frames: DataFrame) -> DataFrame:
    """(file_no, frame_no, doc_no, doc_id, start_in_frame, n_tokens, ids_crc32) of each document, from the coded blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                docs, sizes = batch.column(2)[k].as_py(), np.array(batch.column(3)[k].as_py(), np.int64)
                data = memoryview(batch.column(4)[k].as_buffer())
                ends = np.cumsum(sizes)
                crcs = np.zeros(len(sizes), np.int64)
                at = doc = 0
                while len(data):
                    size = rc.block_length(data)
                    ids = memoryview(rc.decode_block(data[:size]).astype("<u4").tobytes())
                    data = data[size:]
                    upto = at + len(ids) // 4
                    while at < upto:
                        while ends[doc] <= at:
                            doc += 1
                        n = int(min(ends[doc], upto)) - at
                        crcs[doc] = zlib.crc32(ids[: 4 * n], int(crcs[doc]))
                        ids, at = ids[4 * n :], at + n
                if at != (int(ends[-1]) if len(ends) else 0):
                    raise rc.BlockError("a frame holds other ids than its index says")
                n = len(docs)
                yield pa.record_batch([pa.array([batch.column(0)[k].as_py()] * n, pa.int32()), pa.array([batch.column(1)[k].as_py()] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array(docs, pa.int64()), pa.array(ends - sizes), pa.array(sizes), pa.array(crcs)], names=["file_no", "frame_no", "doc_no", "doc_id", "start_in_frame", "n_tokens", "ids_crc32"])

    schema = "file_no int, frame_no int, doc_no bigint, doc_id bigint, start_in_frame bigint, n_tokens bigint, ids_crc32 bigint"
    return in_arrow(frames.select("file_no", "frame_no", "doc_ids", "sizes", "blocks"), run, schema)


def frame_starts(frames: DataFrame) -> DataFrame:
    """(file_no, frame_no, frame_start): ids before each frame, from the index columns alone.

    Files are summed first, so the one window without a key has a row per file.
    """
    index = frames.select("file_no", "frame_no", "n_tokens")
    files = index.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))
    within = Window.partitionBy("file_no").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    index = index.select("file_no", "frame_no", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("in_file"))
    return index.join(files, "file_no").select("file_no", "frame_no", (F.col("in_file") + F.col("file_start")).alias("frame_start"))


def write_token_files(df: DataFrame, path: str, vocabulary: str, alphabet: int, **options) -> None:
    """Writes df's documents as token files in the folder `path`."""
    encode_frames(df, vocabulary, alphabet, **options).write.option("compression", "none").parquet(path)


def read_token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents of the files in `path`."""
    return token_index(spark.read.schema(FRAME_SCHEMA).parquet(path))


def token_index(frames: DataFrame) -> DataFrame:
    starts = frame_starts(frames)
    starts = checked_broadcast(starts, starts.count(), 24)
    out = decode_frames(frames).join(starts, ["file_no", "frame_no"])
    return out.select("doc_id", (F.col("frame_start") + F.col("start_in_frame")).alias("start"), "n_tokens", "ids_crc32")


def token_round_trip(df: DataFrame, vocabulary: str, alphabet: int, **options) -> DataFrame:
    """Writes token files in the shared folder, reads them back and gives each document's digest.

    A null or empty text has its end id alone; rows of one doc_id follow each
    other in order of their text's hash; a null doc_id comes first; an empty
    table gives no rows; other columns play no part.
    """
    return token_index(materialise(encode_frames(df, vocabulary, alphabet, **options), "token-files"))

"""Spark helpers of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, with this package on the executors; a worker gives back what a task freed."""
    ship(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_freed()

    return df.mapInArrow(task, schema)


def release_freed() -> None:
    """Returns freed memory to the system.

    Allocators keep what was freed, at the height of the hungriest task so far, and
    a Python worker lives on between tasks and queries, in its executor's limit.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(ctypes.c_size_t(0))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """As in_arrow, with a function of one batch; empty batches are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return in_arrow(df, run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session that names none, as in tests, gets one in its warehouse;
    on a cluster that would be a folder of one machine, and is an error.
    """
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        held = sc._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared")
            held = sc._jsc.sc().getCheckpointDir()
        told = held.get()
    return told.rstrip("/")


_scratch: dict[str, list[str]] = {}


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and lost executors cost nothing that was written.

    Operators forget what their result no longer reads; the rest goes when the
    driver's Python ends, or by drop_scratch.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scriptorium-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd" if label.endswith("z") else "snappy").parquet(path)
    if spark.sparkContext.applicationId not in _scratch:
        atexit.register(_at_exit, spark)
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def forget(*frames: DataFrame) -> None:
    """Deletes the tables of frames that materialise gave; nothing may read them, or what was derived from them, any more."""
    for df in frames:
        path, mine = df._scratch_path, _scratch.get(df.sparkSession.sparkContext.applicationId, [])
        if path in mine:
            mine.remove(path)
            _delete(df.sparkSession, [path])


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what earlier queries of this session left in the shared folder; their frames can't be read after it."""
    _delete(spark, _scratch.pop(spark.sparkContext.applicationId, []))


def _at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # else it was stopped before, and has no file system any more
        with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone first; its folder is the cluster's to clear then
            drop_scratch(spark)


def checked_broadcast(df: DataFrame, rows: int, row_bytes: int, most: int = 32 << 20) -> DataFrame:
    """A broadcast hint where `rows` rows of at most `row_bytes` bytes are under `most`; else df as it is."""
    return F.broadcast(df) if rows * row_bytes <= most else df

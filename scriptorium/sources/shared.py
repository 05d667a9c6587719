"""Tables that are derived once and read often, in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session that names none gets a folder in its warehouse."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if not told and held.isDefined():
        told = held.get()
    if not told:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        told = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return told.rstrip("/")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def state_of(df: DataFrame, *extra: object) -> str:
    """A digest of the files that df reads (names, lengths, times of change) and of `extra`; another one where any of these changes."""
    spark, parts = df.sparkSession, [str(x) for x in extra]
    for name in sorted(df.inputFiles()):
        fs, p = _fs(spark, name)
        s = fs.getFileStatus(p)
        parts.append(f"{name}\t{s.getLen()}\t{s.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]


def size_of(df: DataFrame) -> int:
    """Bytes of the files that df reads."""
    return sum(fs.getFileStatus(p).getLen() for fs, p in (_fs(df.sparkSession, name) for name in df.inputFiles()))


def materialised(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again; its folder is deleted when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scriptorium-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # else it was stopped before, and has no file system any more
        with contextlib.suppress(Py4JError, OSError):
            fs, p = _fs(spark, path)
            fs.delete(p, True)


def published(spark: SparkSession, name: str) -> str | None:
    """The folder of a derived table, if it was made."""
    path = f"{shared_dir(spark)}/scriptorium-derived/{name}"
    fs, p = _fs(spark, path)
    return path if fs.exists(p) else None


def derived(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    """The folder of a derived table; `write` makes it in a staging folder if it is not there, and a rename publishes it whole."""
    path = f"{shared_dir(spark)}/scriptorium-derived/{name}"
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        staging = f"{path}.{uuid.uuid4().hex}"
        write(staging)
        fs.mkdirs(p.getParent())
        _, s = _fs(spark, staging)
        if not fs.exists(p):
            fs.rename(s, p)
        else:  # another driver was faster
            fs.delete(s, True)
    return path

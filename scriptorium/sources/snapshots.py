"""Staged builds: a table is written aside, checked, and made current by one pointer."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class SnapshotError(ValueError):
    """A staged table failed its checks; what was current still is."""


def _paths(spark: SparkSession, *parts: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(df: DataFrame, root: str, checks: dict[str, Callable[[DataFrame], bool]]) -> str:
    """Writes df as a new version under root, runs the checks on what was written, then moves the pointer; gives the version."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{root}/v={version}")
    staged = spark.read.schema(df.schema).parquet(f"{root}/v={version}")
    failed = [name for name, check in checks.items() if not check(staged)]
    if failed:
        path, fs = _paths(spark, root, f"v={version}")
        fs.delete(path, True)
        raise SnapshotError(", ".join(failed))
    target, fs = _paths(spark, root, "CURRENT")
    fresh, _ = _paths(spark, root, f"CURRENT.{version}")
    out = fs.create(fresh, True)
    out.writeBytes(version)
    out.close()
    _renamed(spark, fresh, target)
    return version


def _renamed(spark: SparkSession, old, new) -> None:
    """One step that puts `old` in the place of `new`: a reader finds the one or the other, never none."""
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    overwrite = sc._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(new.getFileSystem(sc._jsc.hadoopConfiguration()).getUri(), sc._jsc.hadoopConfiguration()).rename(old, new, overwrite)


def current(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.text(f"{root}/CURRENT").first().value
    return spark.read.parquet(f"{root}/v={version}")

"""Session factory with the settings that the plans here are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(cores: int | str = "*", shuffle_partitions: int | None = None, app: str = "scriptorium", **conf: str) -> SparkSession:
    """A local session; on a cluster, spark-submit's own settings come first.

    Adaptive execution splits skewed joins and merges small partitions, so the
    partition count is an upper bound and not a tuning burden.
    """
    n = os.cpu_count() or 8 if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SCRIPTORIUM_DRIVER_MEMORY", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

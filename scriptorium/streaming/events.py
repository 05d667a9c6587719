"""The latest state of each key of a stream of events, and counts by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def latest_state(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, value) of the newest event of each key; an aggregate of bounded state, for complete or update mode."""
    return events.groupBy(key).agg(F.max(F.struct(order, value)).alias("x")).select(key, f"x.{order}", f"x.{value}")


def window_counts(events: DataFrame, time: str, kind: str, width: str, late: str) -> DataFrame:
    """(start, kind, n) of tumbling windows; events later than `late` are dropped, and state of closed windows with them."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return stamped.groupBy(F.window("_t", width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Runs a stream over what is there now into the in-memory table `name`."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query

"""Snapshots and logs: differences, upserts, carry-forward, latest state and leases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): added, changed, unchanged or removed; a null value equals a null."""
    a, b = old.select(key, F.col(value).alias("_old"), F.lit(1).alias("_a")), new.select(key, F.col(value).alias("_new"), F.lit(1).alias("_b"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return both.select(key, status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: str, overwrite: list[str], fill: list[str]) -> DataFrame:
    """Rows of both; of rows in both, `overwrite` columns are the new ones, `fill` columns too unless null."""
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in overwrite + fill], F.lit(1).alias("_in_old"))
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in overwrite + fill], F.lit(1).alias("_in_new"))
    both = o.join(n, key, "full_outer")
    cols = [F.when(F.col("_in_new").isNotNull(), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in overwrite]
    return both.select(key, *cols, *[F.coalesce(F.col(f"_n_{c}"), F.col(f"_o_{c}")).alias(c) for c in fill])


def carry_forward(old: DataFrame, new: DataFrame, identity: str, content: str, key: str) -> DataFrame:
    """(key, status) of new rows: reused, changed, ambiguous (several old rows of the identity) or added."""
    seen = old.groupBy(identity).agg(F.count("*").alias("_n"), F.max(content).alias("_content"))
    both = new.join(seen, identity, "left")
    status = F.when(F.col("_n").isNull(), "added").when(F.col("_n") > 1, "ambiguous").when(F.col("_content").eqNullSafe(F.col(content)), "reused").otherwise("changed")
    return both.select(key, status.alias("status"))


def latest(df: DataFrame, group: list[str], order: str, *columns: str) -> DataFrame:
    """The newest row of each group, by a partial aggregate and not a window."""
    return df.groupBy(*group).agg(F.max_by(F.struct(*columns), order).alias("_x")).select(*group, *[F.col(f"_x.{c}").alias(c) for c in columns])


def numbered(df: DataFrame, group: list[str], *order) -> DataFrame:
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))

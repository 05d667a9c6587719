"""References between rows: neighbourhoods, degrees, aliases, lookups and joins by suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import bare_id


def suffix_join(left: DataFrame, right: DataFrame, target: str, ident: str) -> DataFrame:
    """Rows where `ident` is `target`, or ends with a colon and it: two equality joins in place of OR and LIKE.

    A pair that both find is one row.
    """
    exact = left.join(right, F.col(target) == F.col(ident))
    tail = left.filter(~F.contains(F.col(target), F.lit(":"))).join(right.filter(F.contains(F.col(ident), F.lit(":"))), F.col(target) == bare_id(F.col(ident)))
    return exact.unionByName(tail)


def in_degree(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(target, in_degree): distinct sources of each target; edges are a bag."""
    return edges.groupBy(target).agg(F.countDistinct(source).alias("in_degree"))


def ambiguous(ids: DataFrame, bare: str) -> DataFrame:
    """Bare names that more than one row has."""
    return ids.groupBy(bare).agg(F.count("*").alias("owners")).filter("owners > 1")


def incoming_by_alias(nodes: DataFrame, edges: DataFrame, ident: str, target: str, source: str) -> DataFrame:
    """(ident, in_degree): distinct sources that refer to a row by its id, or by its bare id where no other row has that."""
    nodes = nodes.select(ident, bare_id(F.col(ident)).alias("_bare"))
    lone = nodes.join(ambiguous(nodes, "_bare").select("_bare"), "_bare", "left_anti")
    names = nodes.select(ident, F.col(ident).alias("_alias")).union(lone.select(ident, F.col("_bare"))).distinct()
    return names.join(edges.select(source, F.col(target).alias("_alias")), "_alias").groupBy(ident).agg(F.countDistinct(source).alias("in_degree"))


def first_match(df: DataFrame, conditions: list[Column], *order: str) -> DataFrame:
    """The rows of the first condition that any row meets (adds `priority`), in one scan."""
    rank = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(conditions)])
    hit = df.withColumn("priority", rank).filter("priority is not null")
    return hit.orderBy("priority", *order).limit(1)


def linked(text: Column) -> Column:
    """Targets of href attributes, in order."""
    return F.regexp_extract_all(text, F.lit(r'href="([^"]*)"'), F.lit(1))


def top_by(df: DataFrame, group: str, k: int, *order: Column | str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)

"""Hybrid retrieval: BM25, exact nearest neighbours, rank fusion, re-ranking and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import tokens
from scriptorium.operators.nearest import nearest

K1, B = 1.2, 0.75


def bm25(docs: DataFrame, terms: list[str], key: str, fields: dict[str, float], k: int | None = None, where: Column | None = None) -> DataFrame:
    """(key, bm25) of rows that hold any of the terms, best first; k: only so many.

    Only the query's terms are counted, inside each row, so no postings are
    shuffled: one aggregate gives document frequencies and lengths, and a second,
    narrow pass scores.  fields: text columns and their weights.  where: a filter
    before the limit; statistics are of all rows.
    """
    terms = sorted(set(terms))
    words = {f: tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields}
    held = docs
    for f in fields:
        held = held.withColumn(f"_w_{f}", words[f])
    length = sum((F.size(f"_w_{f}") for f in fields), F.lit(0))

    def weighted(term: str) -> Column:
        return sum((F.lit(float(w)) * F.size(F.filter(f"_w_{f}", lambda x: x == term)) for f, w in fields.items()), F.lit(0.0))

    counted = held.select("*", length.alias("_dl"), *[weighted(t).alias(f"_tf{i}") for i, t in enumerate(terms)])
    counted = counted.drop(*[f"_w_{f}" for f in fields])
    about = counted.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.sum((F.col(f"_tf{i}") > 0).cast("int")).alias(f"_df{i}") for i in range(len(terms))])
    both = counted.crossJoin(F.broadcast(about))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5) + 1)
        tf = F.col(f"_tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))
    any_term = sum((F.col(f"_tf{i}") for i in range(len(terms))), F.lit(0.0)) > 0
    out = both.filter(any_term)
    if where is not None:
        out = out.filter(where)
    out = out.select(key, F.round(score, 6).alias("bm25"))
    return out.orderBy(F.desc("bm25"), key).limit(k) if k else out


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x))


def knn(vectors: DataFrame, query: DataFrame, key: str, vector: str, k: int, prefilter: Column | None = None, postfilter: Column | None = None) -> DataFrame:
    """The k rows nearest to the one row `query` (a column `q`) by L2; prefilter before the limit, postfilter after it."""
    rows = vectors if prefilter is None else vectors.filter(prefilter)
    near = rows.crossJoin(F.broadcast(query.limit(1))).withColumn("distance", F.round(l2(F.col(vector), F.col("q")), 6)).drop("q").orderBy("distance", key).limit(k)
    return near if postfilter is None else near.filter(postfilter)


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """A small ranked list: adds `rank` from 1.  For lists that a limit has bounded."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rrf(lists: list[tuple[DataFrame, float]], key: str, k: int = 60) -> DataFrame:
    """(key, rrf_score): reciprocal rank fusion of ranked lists (key, rank) with weights, rounded to 4 places."""
    parts = [df.select(key, (F.lit(w) / (k + F.col("rank"))).alias("s")) for df, w in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.round(F.sum("s"), 4).alias("rrf_score"))


def confidence(score: Column) -> Column:
    return F.when(score > 0.015, "high").when(score > 0.008, "medium").otherwise("low")


def softmax(df: DataFrame, score: str, over: Window | None = None) -> DataFrame:
    """Adds `rerank_score`, the softmax of a score over the candidates."""
    w = over or Window.partitionBy(F.lit(0))
    e = F.exp(F.col(score) - F.max(score).over(w))
    return df.withColumn("_e", e).withColumn("rerank_score", F.round(F.col("_e") / F.sum("_e").over(w), 4)).drop("_e")


def blend_references(df: DataFrame, relevance: str, references: str, weight: float) -> DataFrame:
    """Adds `adjusted`: relevance, min-max normalised over the candidates, blended with the share of the most references."""
    weight = min(max(weight, 0.0), 1.0)
    w = Window.partitionBy(F.lit(0))
    lo, hi, most = F.min(relevance).over(w), F.max(relevance).over(w), F.max(references).over(w)
    df = df.withColumn("_rel", F.when(hi > lo, (F.col(relevance) - lo) / (hi - lo)).otherwise(F.lit(1.0))).withColumn("_ref", F.when(most > 0, F.col(references) / most).otherwise(F.lit(0.0)))
    return df.withColumn("adjusted", F.round((1 - weight) * F.col("_rel") + weight * F.col("_ref"), 4)).withColumn("ref_score", F.round("_ref", 4)).drop("_rel", "_ref")


def prefer_era(df: DataFrame, name: str, rank: str, flag: str) -> DataFrame:
    """Within rows of one name that have both eras, puts flagged rows first, in the places that the name's rows hold already.

    Adds `place`; ranks are unique.
    """
    by_rank, wanted = Window.partitionBy(name).orderBy(rank), Window.partitionBy(name).orderBy(F.desc(flag), rank)
    all_ = Window.partitionBy(name)
    both = (F.max(F.col(flag).cast("int")).over(all_) == 1) & (F.min(F.coalesce(F.col(flag).cast("int"), F.lit(1))).over(all_) == 0)
    held = df.withColumn("_slot", F.row_number().over(by_rank)).withColumn("_want", F.when(both, F.row_number().over(wanted)).otherwise(F.row_number().over(by_rank)))
    slots = held.select(F.col(name).alias("_n"), F.col("_slot").alias("_s"), F.col(rank).alias("place"))
    return held.join(slots, F.col(name).eqNullSafe(F.col("_n")) & (F.col("_want") == F.col("_s"))).drop("_n", "_s", "_slot", "_want")


def promote(df: DataFrame, explicit: Column, k: int, *order: Column | str) -> DataFrame:
    """Rows that a query names go first, then the rest in order; k rows, with `place`."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.when(explicit, 0).otherwise(1), *order))).filter(F.col("place") <= k)


def topk_per_group(df: DataFrame, group: list[str], k: int, *order: Column | str, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= k)


def knn_batch(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str, query: str, k: int) -> DataFrame:
    """(query_key, key, distance, rank): each query's k nearest vectors by L2; keys are whole numbers."""
    near = nearest(vectors, queries, key, vector, query_key, query, k).withColumn("distance", F.round("distance", 6))
    return topk_per_group(near, [query_key], k, F.asc_nulls_last("distance"), key)


# ---- embedding, re-ranking and the whole search ------------------------------

_EMBEDDERS: dict[str, tuple] = {}


def register_embedder(name: str, factory, query_prefix: str = "", document_prefix: str = "") -> None:
    """Adds an embedder: factory(dims) gives a function of a text column to array<double>; prefixes go before what is embedded."""
    _EMBEDDERS[name] = (factory, query_prefix, document_prefix)


def embedded(text: Column, dims: int, name: str = "hashing", query: bool = False) -> Column:
    """A text's vector of length 1 by a registered embedder."""
    factory, query_prefix, document_prefix = _EMBEDDERS[name]
    prefix = query_prefix if query else document_prefix
    return factory(dims)(F.concat(F.lit(prefix), F.coalesce(text, F.lit(""))) if prefix else F.coalesce(text, F.lit("")))


def _hashing(dims: int):
    """Each word adds 1 or -1 to one component, by its MD5; made here, so that it travels to executors by value."""
    from pyspark.sql.types import ArrayType, DoubleType

    def run(batches):
        import hashlib
        import re

        import numpy as np
        import pandas as pd

        word, seen = re.compile(r"[^\W_]+"), {}

        def place(t: str) -> tuple[int, float]:
            if t not in seen:
                if len(seen) > 200_000:
                    seen.clear()
                d = hashlib.md5(t.encode()).hexdigest()
                seen[t] = (int(d[:8], 16) % dims, 1.0 if int(d[8], 16) < 8 else -1.0)
            return seen[t]

        for texts in batches:
            out = []
            for text in texts:
                v = np.zeros(dims)
                for t in word.findall((text or "").lower()):
                    at, sign = place(t)
                    v[at] += sign
                out.append((v / max(float(np.sqrt(v @ v)), 1e-9)).tolist())
            yield pd.Series(out)

    from collections.abc import Iterator

    import pandas as pd

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(run, ArrayType(DoubleType()))
    return lambda text: udf(text)


register_embedder("hashing", _hashing)


def lexical_score(query_terms: Column, text: Column) -> Column:
    """The default re-ranker's score: the share of a query's terms that a text has."""
    return F.size(F.array_intersect(query_terms, tokens(text))) / F.greatest(F.lit(1), F.size(query_terms))


def clamped(value: int, least: int, most: int) -> int:
    return max(least, min(int(value), most))


def hybrid(semantic: DataFrame, lexical: DataFrame, docs: DataFrame, key: str, text: str, query_terms: Column, k: int, references: str, weight: float = 0.25, explicit: Column | None = None, candidates: int = 50) -> DataFrame:
    """(key, rrf_score, rerank_score, adjusted, confidence, place): fused lists, re-ranked, blended with references, named rows first.

    semantic, lexical: ranked lists (key, rank).  The pool is `candidates` rows, of
    which k leave; a named row stays in it whatever its score.
    """
    k, candidates = clamped(k, 1, 20), clamped(candidates, 1, 100)
    fused = rrf([(semantic, 0.5), (lexical, 0.5)], key)
    pool = docs.join(F.broadcast(fused), key)  # two lists of `candidates` rows at most
    pool = promote(pool, F.lit(False) if explicit is None else explicit, candidates, F.desc("rrf_score"), key).drop("place")
    scored = softmax(pool.withColumn("_s", lexical_score(query_terms, F.col(text))), "_s")
    blended = blend_references(scored, "rerank_score", references, weight)
    out = promote(blended, F.lit(False) if explicit is None else explicit, k, F.desc("adjusted"), F.desc("ref_score"), F.desc("rrf_score"), key)
    return out.select(key, "rrf_score", "rerank_score", "adjusted", confidence(F.col("rrf_score")).alias("confidence"), "place")

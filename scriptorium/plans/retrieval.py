"""Queries: search, ranking and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalogue import register
from scriptorium.functions import text as T
from scriptorium.operators import retrieval as R
from scriptorium.operators import sequences as S
from scriptorium.operators.index import index_of, name_pass, searchable
from scriptorium.operators.nearest import most_shared
from scriptorium.plans.common import table
from scriptorium.sources.shared import materialised

#: The words that the retrieval queries look for, and the vector that they start from.
TERMS = ("that", "idiot", "heed", "ation", "blethe")
_TERMS_SQL = ", ".join(f"'{t}'" for t in TERMS)
_TOK = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"

_BM25_SQL = (
    "WITH d AS (SELECT doc_id, lang, {words} AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d), "
    f"t AS (SELECT unnest([{_TERMS_SQL}]) AS t), "
    "tf AS (SELECT doc_id, lang, len(w) AS dl, t, len(list_filter(w, lambda x: x = t)) * {weight} AS tf FROM d, t), df AS (SELECT t, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY t), "
    "s AS (SELECT doc_id, lang, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS bm25, sum(tf) AS hits FROM tf JOIN df USING (t), n GROUP BY doc_id, lang) "
).replace("{words}", _TOK.format("text"))
_BM25 = _BM25_SQL.replace("{weight}", "1.0")
_KNN = "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id, label, round(sqrt(list_sum(list_transform(range(1, len(q) + 1), lambda i: (CAST(embedding[i] AS DOUBLE) - CAST(q[i] AS DOUBLE)) * (CAST(embedding[i] AS DOUBLE) - CAST(q[i] AS DOUBLE))))), 6) AS distance FROM embeddings, q) "


def _index(spark, sf):
    return index_of(table(spark, sf, "documents"), "doc_id", ["text"])


def _bm25(spark, sf, k=None, where=None):
    allowed = None if where is None else table(spark, sf, "documents").filter(where)
    return searchable(table(spark, sf, "documents"), "doc_id", ["text"]).search(list(TERMS), "doc_id", None, k, allowed)


def _query_vector(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("q"))


def _knn(spark, sf, k, **filters):
    return R.knn(table(spark, sf, "embeddings"), _query_vector(spark, sf), "vec_id", "embedding", k, **filters)


@register("search_terms", f"SELECT item_id, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: list_position(w, p[1]) = p[2]), lambda p: p[1]), ' ') AS terms FROM (SELECT item_id, list_filter({_TOK.format('text')}, lambda x: (length(x) > 2 OR x IN ('ac', 'dc', 'hp', 'xp')) AND x NOT IN ({', '.join(repr(w) for w in T.STOP_WORDS)})) AS w FROM benchmark)")
def search_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(T.search_terms(F.col("text")), " ").alias("terms"))


@register("name_in_query", "WITH q(qid, q) AS (VALUES (1, 'what does the Red, plate do'), (2, 'is a small widget or a red plate better'), (3, 'old'), (4, 'redplate small-widget')), p AS (SELECT DISTINCT p_name FROM part) SELECT qid, count(*) AS n_names FROM q, p WHERE " + " array_to_string(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+'), ' ') <> '' AND contains(' ' || array_to_string(regexp_extract_all(lower(q), '[\\p{L}\\p{N}]+'), ' ') || ' ', ' ' || array_to_string(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+'), ' ') || ' ') GROUP BY qid")
def name_in_query(spark, sf):
    asked = spark.createDataFrame([(1, "what does the Red, plate do"), (2, "is a small widget or a red plate better"), (3, "old"), (4, "redplate small-widget")], "qid int, q string")
    names = table(spark, sf, "part").select("p_name").distinct()
    both = names.crossJoin(F.broadcast(asked))  # four questions
    return both.filter(T.holds_name(F.col("q"), F.col("p_name"))).groupBy("qid").agg(F.count("*").alias("n_names"))


@register("bm25_topk", _BM25 + "SELECT doc_id, bm25 FROM s WHERE hits > 0 ORDER BY bm25 DESC, doc_id LIMIT 10")
def bm25_topk(spark, sf):
    return _bm25(spark, sf, 10)


@register("bm25_filtered", _BM25 + "SELECT doc_id, bm25 FROM s WHERE hits > 0 AND lang = 'en' ORDER BY bm25 DESC, doc_id LIMIT 10")
def bm25_filtered(spark, sf):
    return _bm25(spark, sf, 10, F.col("lang") == "en")


@register("bm25_name_weighted", "WITH d AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+') AS a, regexp_extract_all(lower(p_type), '[\\p{L}\\p{N}]+') AS b FROM part), n AS (SELECT count(*) AS n, avg(len(a) + len(b)) AS av FROM d), t AS (SELECT unnest(['brass', 'red', 'small']) AS t), tf AS (SELECT p_partkey, len(a) + len(b) AS dl, t, len(list_filter(a, lambda x: x = t)) * 10.0 + len(list_filter(b, lambda x: x = t)) * 1.0 AS tf FROM d, t), df AS (SELECT t, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY t), s AS (SELECT p_partkey, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS bm25, sum(tf) AS hits FROM tf JOIN df USING (t), n GROUP BY p_partkey) SELECT p_partkey, bm25 FROM s WHERE hits > 0 ORDER BY bm25 DESC, p_partkey LIMIT 20")
def bm25_name_weighted(spark, sf):
    return searchable(table(spark, sf, "part"), "p_partkey", ["p_name", "p_type"]).search(["brass", "red", "small"], "p_partkey", [10.0, 1.0], 20)


@register("index_postings", f"SELECT term, count(*) AS documents, sum(tf) AS times FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY 1, 2) GROUP BY term")
def index_postings(spark, sf):
    held = _index(spark, sf).postings
    return held.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf_0").alias("times"))


_ASKED = "which red plate or small widget or plate"
_ASKED_TERMS = "['red', 'plate', 'small', 'widget']"


@register("name_pass", "WITH d AS (SELECT p_partkey, p_name, regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+') AS a, regexp_extract_all(lower(p_type), '[\\p{L}\\p{N}]+') AS b FROM part), n AS (SELECT count(*) AS n, avg(len(a) + len(b)) AS av FROM d), t AS (SELECT unnest(" + _ASKED_TERMS + ") AS t), tf AS (SELECT p_partkey, p_name, a, len(a) + len(b) AS dl, t, len(list_filter(a, lambda x: x = t)) * 10.0 AS tf FROM d, t), df AS (SELECT t, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY t), s AS (SELECT p_partkey, p_name, a, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS bm25 FROM tf JOIN df USING (t), n WHERE tf > 0 GROUP BY p_partkey, p_name, a ORDER BY bm25 DESC, p_partkey LIMIT 40) SELECT p_partkey, p_name, bm25 FROM s WHERE contains(' " + _ASKED + " ', ' ' || array_to_string(a, ' ') || ' ')")
def names_in_query(spark, sf):
    parts = table(spark, sf, "part")
    return name_pass(searchable(parts, "p_partkey", ["p_name", "p_type"]), parts, _ASKED, "p_partkey", "p_name", 20)


@register("evidence_lexical", _BM25 + "SELECT doc_id, priority, bm25 FROM (SELECT doc_id, 0 AS priority, CAST(NULL AS DOUBLE) AS bm25 FROM documents WHERE doc_id IN (3, 5) UNION ALL SELECT doc_id, 1, bm25 FROM (SELECT * FROM s WHERE hits > 0 AND doc_id NOT IN (3, 5) ORDER BY bm25 DESC, doc_id LIMIT 16)) ORDER BY priority, bm25 DESC, doc_id LIMIT 8")
def evidence_lexical(spark, sf):
    exact = table(spark, sf, "documents").filter(F.col("doc_id").isin(3, 5)).select("doc_id", F.lit(0).alias("priority"), F.lit(None).cast("double").alias("bm25"))
    found = _bm25(spark, sf, 16, ~F.col("doc_id").isin(3, 5)).select("doc_id", F.lit(1).alias("priority"), "bm25")
    return exact.union(found).orderBy("priority", F.desc("bm25"), "doc_id").limit(8)


@register("knn_topk", _KNN + "SELECT vec_id, distance FROM d ORDER BY distance, vec_id LIMIT 10")
def knn_topk(spark, sf):
    return _knn(spark, sf, 10).select("vec_id", "distance")


@register("knn_postfilter", _KNN + "SELECT vec_id, distance FROM (SELECT * FROM d ORDER BY distance, vec_id LIMIT 50) WHERE label = 2")
def knn_postfilter(spark, sf):
    return _knn(spark, sf, 50, postfilter=F.col("label") == 2).select("vec_id", "distance")


@register("knn_prefilter", _KNN + "SELECT vec_id, distance FROM d WHERE label = 2 ORDER BY distance, vec_id LIMIT 10")
def knn_prefilter(spark, sf):
    return _knn(spark, sf, 10, prefilter=F.col("label") == 2).select("vec_id", "distance")


@register("knn_batch", "WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT query_id, vec_id, round(sqrt(list_sum(list_transform(range(1, len(q) + 1), lambda i: (CAST(embedding[i] AS DOUBLE) - CAST(q[i] AS DOUBLE)) * (CAST(embedding[i] AS DOUBLE) - CAST(q[i] AS DOUBLE))))), 6) AS distance FROM embeddings, q) SELECT query_id, vec_id, distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 5")
def knn_batch(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.knn_batch(vectors, asked, "vec_id", "embedding", "query_id", "q", 5)


_FUSE = _KNN + ", " + _BM25.removeprefix("WITH ").replace("d AS (", "dd AS (").replace("FROM d)", "FROM dd)").replace("FROM d,", "FROM dd,") + ", a AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM (SELECT * FROM d ORDER BY distance, vec_id LIMIT 50)), b AS (SELECT doc_id, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS rank FROM (SELECT * FROM s WHERE hits > 0 ORDER BY bm25 DESC, doc_id LIMIT 50)), f AS (SELECT doc_id, round(sum(0.5 / (60 + rank)), 4) AS rrf_score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id) "
_FUSE = _FUSE.replace(") , ", "), ")


def _fused(spark, sf):
    semantic = R.ranked(_knn(spark, sf, 50).select(F.col("vec_id").alias("doc_id"), "distance"), "distance", "doc_id").select("doc_id", "rank")
    lexical = R.ranked(_bm25(spark, sf, 50), F.desc("bm25"), "doc_id").select("doc_id", "rank")
    return R.rrf([(semantic, 0.5), (lexical, 0.5)], "doc_id")


@register("rrf_hybrid", _FUSE + "SELECT f.doc_id, rrf_score, lang, source FROM f JOIN documents USING (doc_id) ORDER BY rrf_score DESC, f.doc_id LIMIT 20")
def rrf_hybrid(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return docs.join(F.broadcast(_fused(spark, sf)), "doc_id").select("doc_id", "rrf_score", "lang", "source").orderBy(F.desc("rrf_score"), "doc_id").limit(20)  # 100 fused rows at most


_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"


@register(
    "embed_texts",
    f"WITH t AS (SELECT item_id, unnest({_TOKENS}) AS t FROM benchmark), v AS (SELECT item_id, CAST(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 32 AS INTEGER) AS dim, sum(CASE WHEN substr(md5(t), 9, 1) < '8' THEN 1 ELSE -1 END) AS x FROM t GROUP BY 1, 2), n AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM v GROUP BY 1) SELECT item_id, dim, round(x / n, 6) AS value FROM v JOIN n USING (item_id) WHERE x <> 0",
)
def embed_texts(spark, sf):
    held = table(spark, sf, "benchmark").select("item_id", R.embedded(F.col("text"), 32).alias("v"))
    return held.select("item_id", F.posexplode("v").alias("dim", "value")).filter("value <> 0").select("item_id", "dim", F.round("value", 6).alias("value"))


_POOL = ", pool AS (SELECT doc_id, text, rrf_score, (doc_id * 7) % 11 AS refs, doc_id % 13 = 0 AS named FROM f JOIN documents USING (doc_id) ORDER BY named DESC, rrf_score DESC, doc_id LIMIT 50), "


@register(
    "hybrid_search",
    _FUSE + _POOL + f"e1 AS (SELECT *, exp(len(list_intersect([{_TERMS_SQL}], {_TOKENS})) / {len(TERMS)}.0) AS x FROM pool), r1 AS (SELECT *, round(x / (SELECT sum(x) FROM e1), 4) AS rerank_score FROM e1), m1 AS (SELECT min(rerank_score) AS lo, max(rerank_score) AS hi, max(refs) AS mr FROM r1), "
    "z AS (SELECT *, round(0.75 * CASE WHEN hi > lo THEN (rerank_score - lo) / (hi - lo) ELSE 1.0 END + 0.25 * CASE WHEN mr > 0 THEN refs / mr ELSE 0.0 END, 4) AS adjusted, round(CASE WHEN mr > 0 THEN refs / mr ELSE 0.0 END, 4) AS ref_score FROM r1, m1) "
    "SELECT doc_id, rrf_score, rerank_score, adjusted, CASE WHEN rrf_score > 0.015 THEN 'high' WHEN rrf_score > 0.008 THEN 'medium' ELSE 'low' END AS confidence, CAST(row_number() OVER (ORDER BY named DESC, adjusted DESC, ref_score DESC, rrf_score DESC, doc_id) AS INTEGER) AS place FROM z QUALIFY place <= 20",
)
def hybrid_search(spark, sf):
    semantic = R.ranked(_knn(spark, sf, 50).select(F.col("vec_id").alias("doc_id"), "distance"), "distance", "doc_id").select("doc_id", "rank")
    lexical = R.ranked(_bm25(spark, sf, 50), F.desc("bm25"), "doc_id").select("doc_id", "rank")
    docs = table(spark, sf, "documents").select("doc_id", "text", ((F.col("doc_id") * 7) % 11).alias("refs"))
    return R.hybrid(semantic, lexical, docs, "doc_id", "text", F.array(*map(F.lit, TERMS)), 20, "refs", 0.25, F.col("doc_id") % 13 == 0)


@register("confidence_band", _FUSE + "SELECT CASE WHEN rrf_score > 0.015 THEN 'high' WHEN rrf_score > 0.008 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n FROM f GROUP BY 1")
def confidence_band(spark, sf):
    return _fused(spark, sf).groupBy(R.confidence(F.col("rrf_score")).alias("confidence")).agg(F.count("*").alias("n"))


@register("explicit_promotion", _FUSE + "SELECT doc_id, rrf_score, CAST(row_number() OVER (ORDER BY CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 1 END, rrf_score DESC, doc_id) AS INTEGER) AS place FROM f QUALIFY place <= 10")
def explicit_promotion(spark, sf):
    return R.promote(_fused(spark, sf), F.col("doc_id") % 7 == 0, 10, F.desc("rrf_score"), "doc_id")


@register("softmax_rerank", _BM25 + ", c AS (SELECT doc_id, bm25 FROM s WHERE hits > 0 ORDER BY bm25 DESC, doc_id LIMIT 10) SELECT doc_id, round(exp(bm25 - (SELECT max(bm25) FROM c)) / (SELECT sum(exp(bm25 - (SELECT max(bm25) FROM c))) FROM c), 4) AS rerank_score FROM c")
def softmax_rerank(spark, sf):
    return R.softmax(_bm25(spark, sf, 10), "bm25").select("doc_id", "rerank_score")


@register("ref_weight_blend", _BM25 + ", c AS (SELECT doc_id, bm25, (doc_id * 7) % 11 AS refs FROM s WHERE hits > 0 ORDER BY bm25 DESC, doc_id LIMIT 20), m AS (SELECT min(bm25) AS lo, max(bm25) AS hi, max(refs) AS mr FROM c) SELECT doc_id, round(0.75 * CASE WHEN hi > lo THEN (bm25 - lo) / (hi - lo) ELSE 1.0 END + 0.25 * CASE WHEN mr > 0 THEN refs / mr ELSE 0.0 END, 4) AS adjusted, round(CASE WHEN mr > 0 THEN refs / mr ELSE 0.0 END, 4) AS ref_score FROM c, m")
def ref_weight_blend(spark, sf):
    found = _bm25(spark, sf, 20).withColumn("refs", (F.col("doc_id") * 7) % 11)
    return R.blend_references(found, "bm25", "refs", 0.25).select("doc_id", "adjusted", "ref_score")


@register("rules_boost", _KNN + "SELECT vec_id, round(distance - CASE WHEN label = 1 THEN 0.15 WHEN label = 2 THEN 0.05 ELSE 0 END, 6) AS boosted FROM (SELECT * FROM d ORDER BY distance, vec_id LIMIT 50) ORDER BY boosted, vec_id LIMIT 10")
def rules_boost(spark, sf):
    boost = F.when(F.col("label") == 1, 0.15).when(F.col("label") == 2, 0.05).otherwise(0.0)
    return _knn(spark, sf, 50).select("vec_id", F.round(F.col("distance") - boost, 6).alias("boosted")).orderBy("boosted", "vec_id").limit(10)


@register("era_preference_swap", "WITH r AS (SELECT p_partkey, p_name, p_size % 2 = 0 AS remaster, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part), a AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY rank) AS slot, CASE WHEN bool_or(remaster) OVER (PARTITION BY p_name) AND bool_or(NOT remaster) OVER (PARTITION BY p_name) THEN row_number() OVER (PARTITION BY p_name ORDER BY remaster DESC, rank) ELSE row_number() OVER (PARTITION BY p_name ORDER BY rank) END AS want FROM r) SELECT a.p_partkey, CAST(a.rank AS BIGINT) AS rank, CAST(b.rank AS BIGINT) AS place FROM a JOIN a b ON a.p_name = b.p_name AND a.want = b.slot")
def era_preference_swap(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice", (F.col("p_size") % 2 == 0).alias("remaster"))
    held = S.global_rank(parts, "p_retailprice", "p_partkey").select("p_partkey", "p_name", "remaster", "rank")
    return R.prefer_era(held, "p_name", "rank", "remaster").select("p_partkey", "rank", "place")


@register("mrr_eval", "WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM benchmark), t AS (SELECT item_id, unnest(w) AS t FROM b), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS t FROM documents), c AS (SELECT item_id, doc_id, count(*) AS shared FROM t JOIN d USING (t) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rank FROM c QUALIFY rank <= 10), e AS (SELECT b.item_id, min(rank) AS rank FROM benchmark b LEFT JOIN (SELECT r.item_id, r.rank, d.text FROM r JOIN documents d USING (doc_id)) x ON x.item_id = b.item_id AND contains(x.text, b.text) GROUP BY b.item_id) SELECT count(*) AS queries, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, count(*) FILTER (WHERE rank = 1) AS perfect, count(*) FILTER (WHERE rank <= 3) AS top3, count(*) FILTER (WHERE rank <= 5) AS top5, count(*) FILTER (WHERE rank IS NULL) AS not_found FROM e")
def mrr_eval(spark, sf):
    items = table(spark, sf, "benchmark")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    words = F.array_distinct(T.tokens(F.col("text"))).alias("words")
    top = R.topk_per_group(most_shared(docs.select("doc_id", words), items.select("item_id", words), 10), ["item_id"], 10, F.desc("shared"), "doc_id")
    top = materialised(top, "shared")  # ten rows of each item; known to be few, they are sent to the documents
    hits = docs.join(top, "doc_id").join(items.withColumnRenamed("text", "wanted"), "item_id").filter(F.contains("text", "wanted"))
    best = items.select("item_id").join(hits.groupBy("item_id").agg(F.min("rank").alias("rank")), "item_id", "left")
    at = lambda k: F.sum((F.coalesce(F.col("rank") <= k, F.lit(False))).cast("int"))
    return best.agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), at(1).alias("perfect"), at(3).alias("top3"), at(5).alias("top5"), F.sum(F.col("rank").isNull().cast("int")).alias("not_found"))

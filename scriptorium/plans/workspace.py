"""Queries: sync, upsert, deletion, translations, quarantine, leases, gates of a review."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalogue import register
from scriptorium.operators import workspace as W
from scriptorium.plans.common import table

# ---- keeping in step -------------------------------------------------------

_OLD = "o AS (SELECT doc_id, md5(text) AS content, lang AS meta FROM documents WHERE doc_id % 10 <> 3)"
_NEW = "n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN md5(text || '!') ELSE md5(text) END AS content, CASE WHEN doc_id % 10 = 2 THEN source ELSE lang END AS meta FROM documents WHERE doc_id % 10 <> 0)"
_PLAN = f"{_OLD}, {_NEW}, p AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'add' WHEN n.doc_id IS NULL THEN 'remove' WHEN o.content <> n.content THEN 'replace' WHEN o.meta <> n.meta THEN 'touch' ELSE 'keep' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id)"


def _versions(spark, sf):
    docs = table(spark, sf, "documents")
    old = docs.filter("doc_id % 10 <> 3").select("doc_id", F.md5("text").alias("content"), F.col("lang").alias("meta"))
    changed = F.when(F.col("doc_id") % 10 == 1, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text"))
    new = docs.filter("doc_id % 10 <> 0").select("doc_id", changed.alias("content"), F.when(F.col("doc_id") % 10 == 2, F.col("source")).otherwise(F.col("lang")).alias("meta"))
    return old, new


@register("sync_plan", f"WITH {_PLAN} SELECT action, count(*) AS n, min(doc_id) AS least FROM p GROUP BY action")
def sync_plan(spark, sf):
    return W.sync_plan(*_versions(spark, sf), "doc_id", "content", "meta").groupBy("action").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))


@register("sync_counts", f"WITH {_PLAN} SELECT count(*) FILTER (WHERE action <> 'remove') AS active, count(*) FILTER (WHERE action IN ('add', 'replace')) AS changed, count(*) FILTER (WHERE action = 'remove') AS removed, count(*) FILTER (WHERE action IN ('keep', 'touch')) AS unchanged FROM p")
def sync_counts(spark, sf):
    return W.sync_counts(W.sync_plan(*_versions(spark, sf), "doc_id", "content", "meta"))


@register("upsert_snapshot", f"WITH {_OLD}, {_NEW} SELECT doc_id, content, meta FROM n UNION ALL SELECT doc_id, content, meta FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)")
def upsert_snapshot(spark, sf):
    return W.upserted(*_versions(spark, sf), "doc_id")


_CHUNKS = "c AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'e' || p_size WHEN 1 THEN 'e' || p_size || '_page_' || p_partkey WHEN 2 THEN 'e' || p_size || 'Xpage_' || p_partkey ELSE 'e' || p_size || '_page_a_page_' || p_partkey END AS id, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'corpus' ELSE 'packs' END AS origin FROM part)"


@register("delete_entries", f"WITH {_CHUNKS} SELECT p_partkey, id FROM c WHERE NOT (origin = 'packs' AND EXISTS (SELECT 1 FROM (SELECT DISTINCT 'e' || p_size AS b FROM part WHERE p_size % 2 = 0) g WHERE c.id = g.b OR starts_with(c.id, g.b || '_page_')))")
def delete_entries(spark, sf):
    e, k, way = F.concat(F.lit("e"), F.col("p_size").cast("string")), F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    id_ = F.when(way == 0, e).when(way == 1, F.concat(e, F.lit("_page_"), k)).when(way == 2, F.concat(e, F.lit("Xpage_"), k)).otherwise(F.concat(e, F.lit("_page_a_page_"), k))
    parts = table(spark, sf, "part")
    chunks = parts.select("p_partkey", id_.alias("id"), F.when(F.col("p_partkey") % 3 == 0, "corpus").otherwise("packs").alias("origin"))
    gone = parts.filter("p_size % 2 = 0").select(e.alias("base")).distinct()
    return W.without_entries(chunks, gone, "id", "packs").select("p_partkey", "id")


@register("tombstones", "SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1 UNION SELECT 'gone ' || p_type FROM part")
def tombstones(spark, sf):
    parts = table(spark, sf, "part")
    return W.tombstones(parts.select(F.concat(F.lit("gone "), "p_type").alias("p_name")).distinct(), parts, "p_name")


@register("suppressed_products", "SELECT p_partkey FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part GROUP BY p_brand HAVING max(p_size) >= 50)")
def suppressed_products(spark, sf):
    parts = table(spark, sf, "part")
    fuller = parts.groupBy("p_brand").agg(F.max("p_size").alias("m")).filter("m >= 50").select("p_brand")
    return parts.join(fuller, "p_brand", "left_anti").select("p_partkey")


@register("anchor_ownership", "SELECT (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 1)) AS missing, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_linenumber > 1 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS extra, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 1 GROUP BY 1 HAVING count(*) > 1)) AS repeated")
def anchor_ownership(spark, sf):
    owned = table(spark, sf, "lineitem").filter("l_linenumber > 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return W.set_differences(table(spark, sf, "orders"), owned, "o_orderkey")


@register(
    "required_rows",
    "WITH q AS (SELECT p_partkey + CASE WHEN p_partkey % 50 = 0 THEN 100000000 ELSE 0 END AS p_partkey, CASE WHEN p_partkey % 50 = 1 THEN 'other' ELSE p_name END AS p_name, p_brand, CASE p_partkey % 3 WHEN 0 THEN md5(p_type) WHEN 1 THEN md5(p_name) ELSE 'none' END AS hash FROM part) "
    "SELECT * FROM (SELECT q.p_partkey, CASE WHEN p.p_partkey IS NULL THEN 'missing' WHEN q.p_name <> p.p_name THEN 'p_name' WHEN q.p_brand <> p.p_brand THEN 'p_brand' WHEN q.hash NOT IN (md5(p.p_type), md5(p.p_name)) THEN 'hash' END AS problem FROM q LEFT JOIN part p ON p.p_partkey = q.p_partkey) WHERE problem IS NOT NULL",
)
def required_rows(spark, sf):
    parts, k = table(spark, sf, "part"), F.col("p_partkey")
    hash_ = F.when(k % 3 == 0, F.md5("p_type")).when(k % 3 == 1, F.md5("p_name")).otherwise("none")
    asked = parts.select((k + F.when(k % 50 == 0, 100000000).otherwise(0)).alias("p_partkey"), F.when(k % 50 == 1, "other").otherwise(F.col("p_name")).alias("p_name"), "p_brand", hash_.alias("hash"))
    rows = parts.withColumn("h1", F.md5("p_type")).withColumn("h2", F.md5("p_name"))
    return W.unmet(asked, rows, "p_partkey", ["p_name", "p_brand"], ["h1", "h2"])


@register("translations", "WITH t AS (SELECT p_name AS name, max(p_partkey) AS k FROM part WHERE p_size % 2 = 0 GROUP BY p_name) SELECT p.p_partkey, p.p_name AS name, CASE WHEN t.k IS NULL THEN NULL ELSE 'es ' || t.k END AS translated_name, CASE WHEN t.k IS NULL THEN NULL ELSE q.p_type END AS translated_text FROM part p LEFT JOIN t ON t.name = p.p_name LEFT JOIN part q ON q.p_partkey = t.k")
def translations(spark, sf):
    parts = table(spark, sf, "part").withColumnRenamed("p_name", "name")
    told = parts.filter("p_size % 2 = 0").select("name", F.concat(F.lit("es "), F.col("p_partkey").cast("string")).alias("translated_name"), F.col("p_type").alias("translated_text"), F.col("p_partkey").alias("ordinal"))
    return W.merged_translations(parts.select("p_partkey", "name"), told, "name")


# ---- review ----------------------------------------------------------------


@register(
    "quarantine_rollup",
    "SELECT source, CASE WHEN reason IN (" + ", ".join(f"'{r}'" for r in W.REASONS) + ") THEN reason ELSE 'other' END AS reason, CASE WHEN reason NOT IN (" + ", ".join(f"'{r}'" for r in W.REASONS if r not in W.RULE_BEARING) + ") THEN 'rule-bearing' ELSE 'intended' END AS kind, count(*) AS records, sum(n_chars) AS anchors "
    "FROM (SELECT source, n_chars, CASE doc_id % 4 WHEN 0 THEN 'page-number' WHEN 1 THEN 'oversize-block' WHEN 2 THEN 'contents-index' ELSE 'strange' END AS reason FROM documents) GROUP BY ALL",
)
def quarantine_rollup(spark, sf):
    way = F.col("doc_id") % 4
    reason = F.when(way == 0, "page-number").when(way == 1, "oversize-block").when(way == 2, "contents-index").otherwise("strange")
    held = table(spark, sf, "documents").select("source", "n_chars", W.known_reason(reason).alias("reason"))
    return held.groupBy("source", "reason", F.when(F.col("reason").isin(*W.RULE_BEARING), "rule-bearing").otherwise("intended").alias("kind")).agg(F.count("*").alias("records"), F.sum("n_chars").alias("anchors"))


@register("attempts_rollup", "SELECT event_type, user_id % 5 AS model, count(*) AS attempts, count(*) FILTER (WHERE event_id % 3 > 0) AS retries, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2")
def attempts_rollup(spark, sf):
    e = table(spark, sf, "events").withColumn("model", F.col("user_id") % 5)
    return e.groupBy("event_type", "model").agg(F.count("*").alias("attempts"), F.count(F.when(F.col("event_id") % 3 > 0, 1)).alias("retries"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


@register("workspace_status", "SELECT c_mktsegment, count(DISTINCT c_custkey) AS sections, count(o_orderkey) AS candidates, count(*) FILTER (WHERE o_orderstatus = 'F') AS reviews, count(DISTINCT c_custkey) FILTER (WHERE o_orderkey IS NULL) AS available FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def workspace_status(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f"))
    j = table(spark, sf, "customer").join(o, "c_custkey", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return j.groupBy("c_mktsegment").agg(F.count("*").alias("sections"), zero("n").alias("candidates"), zero("f").alias("reviews"), F.count(F.when(F.col("n").isNull(), 1)).alias("available"))


@register("batch_preview", "SELECT source, count(*) AS n, sum(n_chars) AS bytes, min(n_chars) AS least, max(n_chars) AS most, count(*) FILTER (WHERE toxic = 1) AS exact, count(*) FILTER (WHERE quality = 1) AS lexical FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def batch_preview(spark, sf):
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("bytes"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count(F.when(F.col("toxic") == 1, 1)).alias("exact"), F.count(F.when(F.col("quality") == 1, 1)).alias("lexical"))


@register("weighted_quality", "SELECT round(avg(best), 6) AS quality, count(*) FILTER (WHERE best >= 0.8) AS perfect, count(*) FILTER (WHERE best > 0) AS found, count(*) AS topics FROM (SELECT p_brand, max(s / rank) AS best FROM (SELECT p_brand, CASE WHEN p_type = 'ECONOMY' THEN 1.0 WHEN p_type = 'SMALL' THEN 0.5 ELSE 0.0 END AS s, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 5 GROUP BY p_brand)")
def weighted_quality(spark, sf):
    from scriptorium.operators import retrieval as R

    top = R.topk_per_group(table(spark, sf, "part"), ["p_brand"], 5, F.desc("p_retailprice"), "p_partkey")
    score = F.when(F.col("p_type") == "ECONOMY", 1.0).when(F.col("p_type") == "SMALL", 0.5).otherwise(0.0)
    best = top.groupBy("p_brand").agg(F.max(score / F.col("rank")).alias("best"))
    return best.agg(F.round(F.avg("best"), 6).alias("quality"), F.count(F.when(F.col("best") >= 0.8, 1)).alias("perfect"), F.count(F.when(F.col("best") > 0, 1)).alias("found"), F.count("*").alias("topics"))


_JUDGED = "j AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'damaged' ELSE 'valid' END AS status, CASE p_partkey % 3 WHEN 0 THEN 'covered' WHEN 1 THEN 'partial' ELSE 'not-applicable' END AS coverage, CASE WHEN p_size % 3 = 0 THEN [p_type] WHEN p_size % 3 = 1 THEN CAST([] AS VARCHAR[]) ELSE ['x' || p_size] END AS chosen, [p_type, 'x1', 'x2', 'x5'] AS supplied FROM part)"


@register(
    "coverage_gate",
    f"WITH {_JUDGED} SELECT * FROM (SELECT p_partkey, CASE WHEN len(list_filter(chosen, lambda c: NOT list_contains(supplied, c))) > 0 THEN 'unsupplied' WHEN status <> 'valid' THEN CASE WHEN coverage <> 'not-applicable' OR len(chosen) > 0 THEN 'judged invalid input' END WHEN coverage = 'not-applicable' THEN 'not judged' WHEN coverage = 'covered' AND len(chosen) = 0 THEN 'covered by nothing' WHEN coverage <> 'covered' AND len(chosen) > 0 THEN 'chosen but not covered' END AS problem FROM j) WHERE problem IS NOT NULL",
)
def coverage_gate(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    chosen = F.when(s % 3 == 0, F.array("p_type")).when(s % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("x"), s.cast("string"))))
    supplied = F.array(F.col("p_type"), F.lit("x1"), F.lit("x2"), F.lit("x5"))
    coverage = F.when(k % 3 == 0, "covered").when(k % 3 == 1, "partial").otherwise("not-applicable")
    return table(spark, sf, "part").select("p_partkey", W.coverage_problem(F.when(k % 7 == 0, "damaged").otherwise("valid"), coverage, chosen, supplied).alias("problem")).filter("problem is not null")


@register("layout_policy", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_partkey % 3 < 2 THEN 'complex layout' ELSE 'layout not reviewed' END AS problem FROM part WHERE (p_size % 2 = 0 AND p_partkey % 3 < 2) OR (p_size % 2 = 1 AND p_partkey % 5 > 0)")
def layout_policy(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    flags = F.when(k % 3 == 0, F.array(F.lit("table-cell"))).when(k % 3 == 1, F.array(F.lit("plain"), F.lit("oversize-block"))).otherwise(F.array(F.lit("plain")))
    tags = F.when(k % 5 == 0, F.array(F.lit("layout-reviewed"))).otherwise(F.array(F.lit("other")))
    decision = F.when(s % 2 == 0, "PUBLIC_AS_IS").otherwise("MIXED_NEEDS_EXTRACTION")
    return table(spark, sf, "part").select("p_partkey", W.layout_problem(decision, flags, tags).alias("problem")).filter("problem is not null")


@register(
    "lease_state",
    "WITH RECURSIVE c AS (SELECT user_id, event_id * 10 AS t, event_type AS who, row_number() OVER (PARTITION BY user_id ORDER BY event_id * 10, event_type) AS n FROM events), "
    "s AS (SELECT user_id, n, who, t + 3000 AS until FROM c WHERE n = 1 UNION ALL SELECT c.user_id, c.n, CASE WHEN s.until < c.t OR s.who = c.who THEN c.who ELSE s.who END, CASE WHEN s.until < c.t OR s.who = c.who THEN c.t + 3000 ELSE s.until END FROM s JOIN c ON c.user_id = s.user_id AND c.n = s.n + 1) "
    "SELECT user_id, who AS event_type, until AS expires FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1 AND until >= 5000",
)
def lease_state(spark, sf):
    claims = table(spark, sf, "events").select("user_id", "event_type", (F.col("event_id") * 10).alias("at"))
    return W.current_leases(claims, "user_id", "event_type", "at", 3000, F.lit(5000))


@register("independent_votes", "SELECT l_orderkey, count(*) AS votes FROM (SELECT l_orderkey, l_suppkey % 4 AS worker, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS ids FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey HAVING count(*) >= 2 AND count(DISTINCT ids) = 1")
def independent_votes(spark, sf):
    votes = table(spark, sf, "lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 4).alias("worker")).agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("ids"))
    return votes.groupBy("l_orderkey").agg(F.count("*").alias("votes"), F.countDistinct("ids").alias("kinds")).filter("votes >= 2 and kinds = 1").drop("kinds")


@register("approved_rows", "SELECT doc_id FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND NOT EXISTS (SELECT 1 FROM documents e WHERE md5(e.text) = md5(d.text) AND e.doc_id < d.doc_id)")
def approved_rows(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h")), table(spark, sf, "labels")
    first = docs.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return first.join(labels.filter("quality = 1").select("doc_id"), "doc_id", "left_semi").join(labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@register("ownership_counts", "SELECT count(*) FILTER (WHERE source IN ('src1', 'src2')) AS private, count(*) FILTER (WHERE source IS NULL OR source NOT LIKE 'src%') AS unknown, count(*) FILTER (WHERE source NOT IN ('src1', 'src2') AND lang NOT IN ('en', 'de')) AS unapproved FROM documents")
def ownership_counts(spark, sf):
    s, hidden = F.col("source"), F.col("source").isin("src1", "src2")
    return table(spark, sf, "documents").agg(F.count(F.when(hidden, 1)).alias("private"), F.count(F.when(s.isNull() | ~s.startswith("src"), 1)).alias("unknown"), F.count(F.when(~hidden & ~F.col("lang").isin("en", "de"), 1)).alias("unapproved"))


@register("live_claims", "SELECT count(*) > 0 AS live FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O' LIMIT 1)")
def live_claims(spark, sf):
    some = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select("o_orderkey").union(table(spark, sf, "lineitem").filter("l_linestatus = 'O'").select("l_orderkey"))
    return some.limit(1).agg((F.count("*") > 0).alias("live"))


@register("query_keys", "SELECT item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')))[1:12], ' ') AS key FROM benchmark")
def query_keys(spark, sf):
    from scriptorium.functions.text import tokens

    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.slice(F.array_sort(F.array_distinct(tokens(F.col("text")))), 1, 12), " ").alias("key"))

"""Queries: catalogues, duplicates, containment, quality, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalogue import register
from scriptorium.functions import text as T
from scriptorium.operators import curation as C
from scriptorium.operators import retrieval as R
from scriptorium.plans.common import table
from scriptorium.plans.coverage import _NUMBERS, _TRIGRAMS

_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


@register("catalog_by_lang", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def catalog_by_lang(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@register("catalog_by_source_top20", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 20")
def catalog_by_source_top20(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(20)


@register("catalog_tristate", "SELECT CASE WHEN l.quality = 1 THEN 'current' WHEN l.quality = 0 THEN 'legacy' ELSE 'unknown' END AS era, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def catalog_tristate(spark, sf):
    era = F.when(F.col("quality") == 1, "current").when(F.col("quality") == 0, "legacy").otherwise("unknown")
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").groupBy(era.alias("era")).agg(F.count("*").alias("n"))


@register("build_stats", "SELECT lang, count(*) AS n, sum(length(text)) AS chars, round(avg(length(text)), 6) AS mean_chars FROM documents GROUP BY lang")
def build_stats(spark, sf):
    n = F.char_length("text")
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(n).alias("chars"), F.round(F.avg(n), 6).alias("mean_chars"))


@register("index_status", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS vectors, (SELECT max(len(embedding)) FROM embeddings) AS dims, (SELECT count(DISTINCT source) FROM documents) AS sources")
def index_status(spark, sf):
    d = table(spark, sf, "documents").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"))
    e = table(spark, sf, "embeddings").agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dims"))
    return d.crossJoin(e)  # one row each


@register("staged_invariants", "SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, count(*) FILTER (WHERE text IS NULL OR text = '') AS blank, count(*) FILTER (WHERE n_chars <> length(text)) AS wrong_length, count(*) = count(DISTINCT doc_id) AS valid FROM documents")
def staged_invariants(spark, sf):
    blank, wrong = F.col("text").isNull() | (F.col("text") == ""), F.col("n_chars") != F.char_length("text")
    return table(spark, sf, "documents").agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids"), F.count(F.when(blank, 1)).alias("blank"), F.count(F.when(wrong, 1)).alias("wrong_length"), (F.count("*") == F.countDistinct("doc_id")).alias("valid"))


@register("duplicate_ids", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return table(spark, sf, "part").groupBy("p_name").agg(F.count("*").alias("n")).filter("n > 1")


@register("metadata_filter_false_excludes_null", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality = 0 AND d.lang = 'en'")
def metadata_filter(spark, sf):
    return table(spark, sf, "documents").filter(F.col("lang") == "en").join(table(spark, sf, "labels"), "doc_id", "left").filter(F.col("quality") == 0).select("doc_id")


@register("substring_scope", "SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', source, lang, text)), 'src1') AND NOT contains(lower(concat_ws(' ', source, lang, text)), 'idiot')")
def substring_scope(spark, sf):
    x = F.lower(F.concat_ws(" ", "source", "lang", "text"))
    return table(spark, sf, "documents").filter(F.contains(x, F.lit("src1")) & ~F.contains(x, F.lit("idiot"))).select("doc_id")


_GROUPS = "WITH g AS (SELECT doc_id, sha256(lang || chr(10) || array_to_string(" + _TOK.format("text") + ", ' ')) AS group_id FROM documents), s AS (SELECT group_id, count(*) AS size, min(doc_id) AS least FROM g GROUP BY group_id) "


def _groups(spark, sf):
    return C.duplicate_groups(table(spark, sf, "documents"), [F.col("lang"), T.normal_name(F.col("text"))], "doc_id")


@register("exact_dup_groups", _GROUPS + "SELECT group_id, size, least AS canonical FROM s WHERE size > 1")
def exact_dup_groups(spark, sf):
    return _groups(spark, sf).filter("size > 1 and is_canonical").select("group_id", "size", F.col("doc_id").alias("canonical"))


@register("dup_canonical", _GROUPS + "SELECT doc_id, size, doc_id = least AS is_canonical FROM g JOIN s USING (group_id)")
def dup_canonical(spark, sf):
    return _groups(spark, sf).select("doc_id", "size", "is_canonical")


@register("anti_shadow", _GROUPS + "SELECT d.doc_id, d.lang FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM g JOIN s USING (group_id) WHERE doc_id <> least)")
def anti_shadow(spark, sf):
    shadows = _groups(spark, sf).filter("not is_canonical").select("doc_id")
    return table(spark, sf, "documents").join(shadows, "doc_id", "left_anti").select("doc_id", "lang")


_CONTAIN = (
    "WITH i AS (SELECT item_id, " + _TOK.format("text") + " AS iw, " + _NUMBERS.format("text") + " AS inum FROM benchmark), d AS (SELECT doc_id, " + _TOK.format("text") + " AS dw, " + _NUMBERS.format("text") + " AS dnum FROM documents), "
    "a AS (SELECT item_id, unnest(list_distinct(iw)) AS t FROM i), h AS (SELECT doc_id, unnest(list_distinct(dw)) AS t FROM d), "
    "p AS (SELECT item_id, doc_id FROM a JOIN h USING (t) JOIN i USING (item_id) GROUP BY item_id, doc_id, len(list_distinct(iw)) HAVING round(count(*) / greatest(1, len(list_distinct(iw))), 6) >= 0.6), "
    "c AS (SELECT item_id, doc_id, round(len(list_intersect(iw, dw)) / greatest(1, len(list_distinct(iw))), 6) AS token_coverage, round(len(list_intersect(" + _TRIGRAMS.format("iw") + ", " + _TRIGRAMS.format("dw") + ")) / greatest(1, len(" + _TRIGRAMS.format("iw") + ")), 6) AS trigram_coverage, "
    "round(len(list_intersect(inum, dnum)) / greatest(1, len(list_distinct(inum))), 6) AS numeric_coverage FROM p JOIN i USING (item_id) JOIN d USING (doc_id)) "
    "SELECT item_id, doc_id, token_coverage, trigram_coverage, numeric_coverage, CAST(row_number() OVER (PARTITION BY item_id ORDER BY token_coverage DESC, trigram_coverage DESC, doc_id) AS INTEGER) AS rank FROM c WHERE token_coverage >= 0.6 QUALIFY rank <= 3"
)


@register("containment_top3", _CONTAIN)
def containment_top3(spark, sf):
    return C.containment(table(spark, sf, "benchmark"), table(spark, sf, "documents"))


@register("privacy_scan", "SELECT kinds, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN contains(text, '@') THEN 'at' END, CASE WHEN regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') THEN 'control' END, CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') THEN 'email' END, CASE WHEN contains(lower(text), '\\users\\') OR contains(lower(text), '/home/') OR contains(lower(text), '/users/') THEN 'home' END, CASE WHEN contains(lower(text), 'example.org') THEN 'marker' END, CASE WHEN regexp_matches(text, '[A-Za-z]:\\\\') THEN 'path' END) AS kinds FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)) GROUP BY kinds")
def privacy_scan(spark, sf):
    texts = table(spark, sf, "documents").select("text").union(table(spark, sf, "conversations").select("text"))
    return texts.groupBy(T.private_marks(F.col("text"), ("example.org",)).alias("kinds")).agg(F.count("*").alias("n"))


_BUCKET = "CASE WHEN length(text) < 40 THEN 'under-40' WHEN length(text) < 80 THEN '40-79' WHEN length(text) < 500 THEN '80-499' WHEN length(text) < 2000 THEN '500-1999' WHEN length(text) < 5000 THEN '2000-4999' WHEN length(text) < 10000 THEN '5000-9999' ELSE '10000-plus' END"


@register("length_buckets", f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM documents GROUP BY 1")
def length_buckets(spark, sf):
    return table(spark, sf, "documents").groupBy(C.length_bucket(F.char_length("text")).alias("bucket")).agg(F.count("*").alias("n"))


_HEAD = "split_part(text, chr(10), 1)"


@register("heading_defects", f"SELECT source, count(*) FILTER (WHERE regexp_matches({_HEAD}, '^[0-9 .]+$')) AS numeric_only, count(*) FILTER (WHERE length({_HEAD}) > 80 OR len(string_split({_HEAD}, ' ')) >= 16 OR (len(string_split({_HEAD}, ' ')) >= 8 AND regexp_matches({_HEAD}, '[.!?]$'))) AS sentence_like FROM documents GROUP BY source")
def heading_defects(spark, sf):
    h = F.substring_index("text", "\n", 1)
    words = F.size(F.split(h, " "))
    like = (F.char_length(h) > 80) | (words >= 16) | ((words >= 8) & h.rlike("[.!?]$"))
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.when(h.rlike("^[0-9 .]+$"), 1)).alias("numeric_only"), F.count(F.when(like, 1)).alias("sentence_like"))


@register("probe_matrix", "SELECT lang, count(*) FILTER (WHERE (contains(lower(text), 'license') AND contains(lower(text), 'version')) OR contains(lower(text), 'reserved')) AS legal, count(*) FILTER (WHERE contains(lower(text), '@') AND contains(lower(text), 'example')) AS contact FROM documents GROUP BY lang")
def probe_matrix(spark, sf):
    has = lambda x: F.contains(F.lower("text"), F.lit(x))
    return table(spark, sf, "documents").groupBy("lang").agg(F.count(F.when((has("license") & has("version")) | has("reserved"), 1)).alias("legal"), F.count(F.when(has("@") & has("example"), 1)).alias("contact"))


_PROFILE = "SELECT source, count(*) AS sections, CASE WHEN count(quality) = count(*) THEN sum(quality) END AS good, count(quality) AS judged, sum(length(text)) AS chars, count(*) FILTER (WHERE length(text) > 7800) AS oversized FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (source)"


@register("quality_profile_rollup", _PROFILE)
def quality_profile_rollup(spark, sf):
    n = F.char_length("text")
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return both.rollup("source").agg(F.count("*").alias("sections"), C.whole_total(F.col("quality"), "good"), F.count("quality").alias("judged"), F.sum(n).alias("chars"), F.count(F.when(n > 7800, 1)).alias("oversized"))


@register("quality_gate_compare", "WITH b AS (SELECT source, count(*) FILTER (WHERE length(text) > 1000) AS before, count(*) FILTER (WHERE length(text) > 4000) AS after FROM documents GROUP BY source) SELECT source, before, after, round(CASE WHEN before = 0 THEN CASE WHEN after = 0 THEN 1.0 ELSE 0.0 END ELSE (before - after) / before END, 6) AS reduction, CASE WHEN before = 0 THEN after = 0 ELSE (before - after) / before >= 0.5 END AS passed FROM b")
def quality_gate_compare(spark, sf):
    n = F.char_length("text")
    both = table(spark, sf, "documents").groupBy("source").agg(F.count(F.when(n > 1000, 1)).alias("before"), F.count(F.when(n > 4000, 1)).alias("after"))
    fell = C.reduction(F.col("before"), F.col("after"))
    return both.select("source", "before", "after", F.round(fell, 6).alias("reduction"), (fell >= 0.5).alias("passed"))


@register("repair_gates", "WITH b AS (SELECT source, count(*) AS sections, count(DISTINCT text) AS texts, count(*) FILTER (WHERE length(text) < 80) AS short FROM documents GROUP BY source) SELECT bool_and(texts <= sections) AS conserved, bool_and(short <= 0.25 * sections) AS per_source, sum(short) <= 0.2 * sum(sections) AS overall FROM b")
def repair_gates(spark, sf):
    b = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("sections"), F.countDistinct("text").alias("texts"), F.count(F.when(F.char_length("text") < 80, 1)).alias("short"))
    return b.agg(F.bool_and(F.col("texts") <= F.col("sections")).alias("conserved"), F.bool_and(F.col("short") <= 0.25 * F.col("sections")).alias("per_source"), (F.sum("short") <= 0.2 * F.sum("sections")).alias("overall"))


@register("anchor_coverage", "SELECT count(*) AS assigned, count(DISTINCT l_orderkey) AS anchors, count(*) - count(DISTINCT l_orderkey) AS duplicates, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS missing, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS extra FROM lineitem")
def anchor_coverage(spark, sf):
    li, o = table(spark, sf, "lineitem").select("l_orderkey"), table(spark, sf, "orders").select("o_orderkey")
    have = li.agg(F.count("*").alias("assigned"), F.countDistinct("l_orderkey").alias("anchors"))
    missing = o.join(li, o["o_orderkey"] == li["l_orderkey"], "left_anti").agg(F.count("*").alias("missing"))
    extra = li.distinct().join(o, li["l_orderkey"] == o["o_orderkey"], "left_anti").agg(F.count("*").alias("extra"))
    return have.crossJoin(missing).crossJoin(extra).select("assigned", "anchors", (F.col("assigned") - F.col("anchors")).alias("duplicates"), "missing", "extra")  # one row each


@register("integrity_audit", "SELECT count(*) AS rows, count(*) FILTER (WHERE o_orderkey IS NULL) AS no_order, count(*) FILTER (WHERE c_custkey IS NULL) AS no_customer, count(*) FILTER (WHERE n_nationkey IS NULL) AS no_nation, count(*) FILTER (WHERE r_regionkey IS NULL) AS no_region FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def integrity_audit(spark, sf):
    li, o, c, n, r = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    j = li.select("l_orderkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    j = j.join(n.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r.select("r_regionkey"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    lack = lambda k, name: F.count(F.when(F.col(k).isNull(), 1)).alias(name)
    return j.agg(F.count("*").alias("rows"), lack("o_orderkey", "no_order"), lack("c_custkey", "no_customer"), lack("n_nationkey", "no_nation"), lack("r_regionkey", "no_region"))


@register("table_digest", "SELECT sha256(CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31), p_partkey, p_name, p_brand, p_type, p_size)), 1, 12) AS BIGINT)) AS VARCHAR) || ':' || count(*)) AS digest, count(*) AS n FROM part")
def table_digest(spark, sf):
    return C.table_digest(table(spark, sf, "part"), ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])


@register("repeated_furniture", "SELECT line, count(DISTINCT doc_id) AS documents, count(*) AS times FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) BETWEEN 1 AND 160 GROUP BY line HAVING count(DISTINCT doc_id) >= 2")
def repeated_furniture(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.char_length("line").between(1, 160))
    per_doc = lines.groupBy("line", "doc_id").agg(F.count("*").alias("c"))
    return per_doc.groupBy("line").agg(F.count("*").alias("documents"), F.sum("c").alias("times")).filter("documents >= 2")


@register("median_by_group", "SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 4) AS median_price FROM lineitem GROUP BY 1, 2")
def median_by_group(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.median("l_extendedprice"), 4).alias("median_price"))


@register("argmin_lexicographic", "SELECT p_brand, p_partkey AS chosen FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice, p_name, p_partkey) = 1")
def argmin_lexicographic(spark, sf):
    key = F.struct((-F.col("p_size")).alias("s"), "p_retailprice", "p_name", "p_partkey")
    return table(spark, sf, "part").groupBy("p_brand").agg(F.min_by("p_partkey", key).alias("chosen"))


@register("set_valued_aggregate", "SELECT c_mktsegment, string_agg(DISTINCT CAST(c_nationkey AS VARCHAR), ',' ORDER BY CAST(c_nationkey AS VARCHAR)) AS nations FROM customer GROUP BY 1")
def set_valued_aggregate(spark, sf):
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.array_join(F.sort_array(F.collect_set(F.col("c_nationkey").cast("string"))), ",").alias("nations"))


@register("status_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 200000) AS large, round(max(o_totalprice), 2) AS most FROM orders GROUP BY 1, 2")
def status_rollup(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.count(F.when(F.col("o_totalprice") > 200000, 1)).alias("large"), F.round(F.max("o_totalprice"), 2).alias("most"))


@register("unclaimed_work", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O')")
def unclaimed_work(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").filter(F.col("o_orderstatus") == "O")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@register("role_disagreement", "SELECT l_returnflag, count(*) AS n FROM (SELECT DISTINCT a.l_orderkey, a.l_returnflag FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linestatus = 'F' AND b.l_linestatus = 'O' AND a.l_returnflag <> b.l_returnflag) GROUP BY 1")
def role_disagreement(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus").distinct()
    a, b = li.filter("l_linestatus = 'F'"), li.filter("l_linestatus = 'O'").select("l_orderkey", F.col("l_returnflag").alias("other"))
    return a.join(b, "l_orderkey").filter("l_returnflag <> other").select("l_orderkey", "l_returnflag").distinct().groupBy("l_returnflag").agg(F.count("*").alias("n"))


_PAIRS = (
    "WITH c AS (SELECT a.p_partkey AS x, b.p_partkey AS y, CASE WHEN a.p_size = b.p_size THEN 10 WHEN a.p_type = b.p_type THEN 5 ELSE 3 END AS weight FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey AND abs(a.p_size - b.p_size) <= 1), "
    "k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY x ORDER BY weight DESC, y) <= 2) SELECT x AS p_partkey, y AS negative, weight FROM k QUALIFY row_number() OVER (PARTITION BY least(x, y), greatest(x, y) ORDER BY x) = 1"
)


@register("hard_negative_pairs", _PAIRS)
def hard_negative_pairs(spark, sf):
    return C.hard_negatives(table(spark, sf, "part"), "p_partkey", "p_brand", "p_size", "p_type", 2)

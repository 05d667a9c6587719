"""Queries: headings, furniture, reading order and sections, on lines that the tables stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalogue import register
from scriptorium.functions.text import upper_each
from scriptorium.operators import layout as L
from scriptorium.plans.common import table

_FIRST = "split_part(text, chr(10), 1)"
_BOLD = "(doc_id % 6) / 5.0"


@register(
    "heading_kinds",
    f"WITH l AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper({_FIRST}) ELSE {_FIRST} END AS t, 9.0 + (doc_id % 9) * 0.5 AS size, {_BOLD} AS bold FROM documents), "
    "u AS (SELECT *, length(t) <= 160 AND NOT regexp_matches(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AND length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) >= 3 AS ok, upper(t) = t AND regexp_matches(t, '\\p{L}') AND length(t) < 90 AS caps FROM l) "
    "SELECT doc_id, ok AND (size >= 12.5 OR (bold >= 0.8 AND size >= 10.75) OR (caps AND bold >= 0.8 AND size >= 11.5)) AS strict, ok AND (size >= 12.5 OR (bold >= 0.8 AND size >= 10.75) OR (caps AND size >= 10)) AS loose FROM u",
)
def heading_kinds(spark, sf):
    first = F.substring_index("text", "\n", 1)
    text, size = F.when(F.col("doc_id") % 3 == 0, upper_each(first)).otherwise(first), 9.0 + (F.col("doc_id") % 9) * 0.5
    fonts = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i < F.col("doc_id") % 6, "Face-SemiBold").otherwise("Face-Roman"))
    of = lambda strict: L.is_heading(F.col("t"), F.col("size"), F.col("fonts"), F.lit(10.0), strict, upper_each)
    return table(spark, sf, "documents").select("doc_id", text.alias("t"), size.alias("size"), fonts.alias("fonts")).select("doc_id", of(True).alias("strict"), of(False).alias("loose"))


_NORMAL = "array_to_string(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), ' ')"


@register(
    "page_kinds",
    f"WITH l AS (SELECT doc_id, unnest(string_split(text || CASE doc_id % 5 WHEN 0 THEN chr(10) || 'Contents' WHEN 1 THEN chr(10) || 'The ORC License, in full' WHEN 2 THEN chr(10) || 'Authors: a' || chr(10) || 'Editors: b' || chr(10) || 'Designers: c' ELSE '' END, chr(10))) AS x FROM documents), "
    f"n AS (SELECT doc_id, x, {_NORMAL.format('x')} AS t FROM l), c AS (SELECT doc_id, bool_or(t IN ('contents', 'table of contents', 'index', 'subject index')) AS titled, count(*) AS n, count(*) FILTER (WHERE regexp_matches(x, '(?:\\.{{2,}}|\\s)\\d{{1,4}}\\s*$')) AS leaders, bool_or(regexp_matches(t, '{'|'.join(L.LEGAL)}')) AS legal, count(*) FILTER (WHERE regexp_matches(t, '{'|'.join(L.ROLES)}')) AS roles FROM n GROUP BY doc_id) "
    "SELECT doc_id, CASE WHEN titled OR (n >= 8 AND leaders >= greatest(5, n // 3)) THEN 'contents-index' WHEN legal OR (doc_id % 20 <= 12 AND roles >= 3) THEN 'credits-legal' END AS kind FROM c",
)
def page_kinds(spark, sf):
    way = F.col("doc_id") % 5
    more = F.when(way == 0, "\nContents").when(way == 1, "\nThe ORC License, in full").when(way == 2, "\nAuthors: a\nEditors: b\nDesigners: c").otherwise("")
    docs = table(spark, sf, "documents").select("doc_id", F.split(F.concat("text", more), "\n").alias("lines"))
    return docs.select("doc_id", L.page_kind(F.col("doc_id") % 20, F.col("lines")).alias("kind"))


_LINES = "l AS (SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey AS o, l_quantity * 10 AS x0, l_quantity * 10 + 100 + (l_partkey % 7) * 60 AS x1, CAST((l_suppkey * 13 + l_linenumber * 29) % 300 AS DOUBLE) AS top FROM lineitem)"


def _order():
    """Lines of an order by number, then what they are of: numbers alone repeat."""
    return F.col("l_linenumber").cast("bigint") * 1000000000000 + F.col("l_partkey") * 1000000 + F.col("l_suppkey")


def _lines(spark, sf):
    q = F.col("l_quantity") * 10
    top = ((F.col("l_suppkey") * 13 + F.col("l_linenumber") * 29) % 300).cast("double")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), _order().alias("o"), q.alias("x0"), (q + 100 + (F.col("l_partkey") % 7) * 60).alias("x1"), top.alias("top"))


@register("reading_order", f"WITH {_LINES}, b AS (SELECT *, x1 - x0 > 400 AS spans FROM l), c AS (SELECT *, sum(CAST(spans AS INTEGER)) OVER (PARTITION BY page ORDER BY top, x0, o ROWS UNBOUNDED PRECEDING) AS band FROM b) SELECT page, o, CAST(row_number() OVER (PARTITION BY page ORDER BY band, CASE WHEN spans THEN 0 WHEN (x0 + x1) / 2 < 400 THEN 1 ELSE 2 END, top, x0, o) AS INTEGER) AS place FROM c")
def reading_order(spark, sf):
    return L.reading_order(_lines(spark, sf), "page", F.lit(400.0), F.col("x1") - F.col("x0") > 400, "top", "x0", "x1", "o").select("page", "o", "place")


@register(
    "order_conflicts",
    f"WITH {_LINES}, a AS (SELECT *, lead(o) OVER w AS o2, lead(x0) OVER w AS y0, lead(x1) OVER w AS y1, lead(top) OVER w AS t2 FROM l WINDOW w AS (PARTITION BY page ORDER BY o)), h AS (SELECT page, o, o2 FROM a WHERE o2 IS NOT NULL AND greatest(0, least(x1, y1) - greatest(x0, y0)) / least(greatest(1, x1 - x0), greatest(1, y1 - y0)) >= 0.5 AND t2 + 2 < top) SELECT page, o FROM h UNION SELECT page, o2 FROM h",
)
def order_conflicts(spark, sf):
    return L.order_conflicts(_lines(spark, sf), "page", "o")


@register("split_regions", "SELECT l_partkey, count(DISTINCT l_linenumber) AS sections FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) BETWEEN 2 AND 3 AND max(l_linenumber) - min(l_linenumber) = count(DISTINCT l_linenumber) - 1")
def split_regions(spark, sf):
    return L.split_regions(table(spark, sf, "lineitem"), "l_partkey", "l_linenumber")


@register(
    "cut_sections",
    "WITH RECURSIVE b AS (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey AS o, floor(l_extendedprice / 8) AS n, l_linenumber % 3 = 1 AS h, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem), "
    "s AS (SELECT k, o, i, 0 AS part, n AS held, NOT h AS body FROM b WHERE i = 1 UNION ALL SELECT b.k, b.o, b.i, CASE WHEN s.held + b.n + 1 > 7800 AND s.body THEN s.part + 1 ELSE s.part END, CASE WHEN s.held + b.n + 1 > 7800 AND s.body THEN b.n ELSE s.held + b.n + 1 END, CASE WHEN s.held + b.n + 1 > 7800 AND s.body THEN NOT b.h ELSE s.body OR NOT b.h END FROM s JOIN b ON b.k = s.k AND b.i = s.i + 1) "
    "SELECT k AS l_orderkey, o AS place, CAST(part AS INTEGER) AS part FROM s",
)
def cut_sections(spark, sf):
    ids = ("l_linenumber", "l_partkey", "l_suppkey")
    blocks = table(spark, sf, "lineitem").select("l_orderkey", *ids, _order().alias("place"), F.floor(F.col("l_extendedprice") / 8).alias("n"), (F.col("l_linenumber") % 3 == 1).alias("h"))
    return L.cut_sections(blocks, "l_orderkey", "place", "n", "h", by=ids)


@register("page_furniture", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, len(string_split(text, chr(10))) AS n FROM documents), f AS (SELECT DISTINCT doc_id, array_to_string(regexp_extract_all(lower(regexp_replace(x, '\\b\\d+\\b', '', 'g')), '[\\p{L}\\p{N}]+'), ' ') AS line FROM l WHERE i < n * 0.12 OR i + 1 > n * 0.88) SELECT line, count(*) AS pages FROM f WHERE line <> '' GROUP BY line HAVING count(*) >= 2")
def page_furniture(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("l")).select("doc_id", F.size("l").alias("n"), F.posexplode("l").alias("i", "x")).withColumn("end", F.col("i") + 1)
    return L.furniture(lines, "doc_id", "x", "i", "end", "n")


@register("slug_ordinals", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY source, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(split_part(text, ' ', 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'section') ORDER BY doc_id) AS INTEGER) AS ordinal FROM documents")
def slug_ordinals(spark, sf):
    from pyspark.sql import Window

    from scriptorium.functions.text import slug

    docs = table(spark, sf, "documents").select("doc_id", "source", slug(F.substring_index("text", " ", 1)).alias("slug"))
    return docs.select("doc_id", F.row_number().over(Window.partitionBy("source", "slug").orderBy("doc_id")).alias("ordinal"))


@register("clean_lines", "WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' || p_type || '  x' || p_size || '@mail.example.org end' ELSE array_to_string(list_transform(string_split(p_name || ' ' || p_type, ' '), lambda w: w || ' ' || upper(w)), ' ') END AS raw FROM part) SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN trim(regexp_replace(regexp_replace(raw, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '', 'g'), '\\s+', ' ', 'g')) ELSE (SELECT p_name || ' ' || p_type FROM part q WHERE q.p_partkey = t.p_partkey) END AS said FROM t")
def clean_lines(spark, sf):
    both = F.concat_ws(" ", "p_name", "p_type")
    doubled = F.array_join(F.transform(F.split(both, " "), lambda w: F.concat(w, F.lit(" "), F.upper(w))), " ")
    mail = F.concat(both, F.lit("  x"), F.col("p_size").cast("string"), F.lit("@mail.example.org end"))
    return table(spark, sf, "part").select("p_partkey", L.clean_text(F.when(F.col("p_partkey") % 2 == 0, mail).otherwise(doubled)).alias("said"))


@register("stable_identities", "WITH b AS (SELECT p_partkey, p_type, sha256('section-identity-v2' || chr(10) || p_brand || chr(10) || p_name || chr(10) || p_size) AS base FROM part) SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN sha256('collision-1' || chr(10) || base || chr(10) || p_type || ':' || p_partkey) ELSE base END AS identity FROM b")
def stable_identities(spark, sf):
    apart = F.concat("p_type", F.lit(":"), F.col("p_partkey").cast("string"))
    return L.stable_identities(table(spark, sf, "part"), ["p_brand", "p_name", "p_size"], apart).select("p_partkey", "identity")

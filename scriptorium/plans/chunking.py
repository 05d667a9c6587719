"""Queries: entries and journals as chunks, made from the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalogue import register
from scriptorium.functions.text import strip_listed
from scriptorium.operators import chunks as K
from scriptorium.plans.common import table
from scriptorium.sources.shared import materialised

_LINK = "'<p>See @UUID[Compendium.x.Item.p' || (p_partkey + 1) || ']{next} &amp; rest</p>'"


def _entries(spark, sf):
    """Parts as entries of a pack."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    item = lambda k: F.concat(F.lit("Compendium.x.Item.p"), k)
    text = F.concat(F.lit("<p>See @UUID["), item((F.col("p_partkey") + 1).cast("string")), F.lit("]{next} &amp; rest</p>"))
    rules = F.array(
        F.to_json(F.struct(F.lit("FlatModifier").alias("key"), size.alias("value"), F.lit("item").alias("type"), F.lit("ac").alias("selector"))),
        F.to_json(F.struct(F.lit("GrantItem").alias("key"), item(key).alias("uuid"))),
        F.to_json(F.struct(F.lit("Aura").alias("key"), size.alias("radius"))),
        F.to_json(F.struct(F.lit("Odd").alias("key"), F.col("p_type").alias("x"))),
    )
    system = F.concat(
        F.lit('{"slug":'), F.to_json(F.array(F.lower("p_type"))), F.lit(',"level":{"value":'), size.cast("string"), F.lit('},"traits":{"value":'), F.to_json(F.array("p_brand", F.lit("common"))), F.lit('},"description":{"value":'), F.to_json(F.array(text)),
        F.lit('},"category":"general","rules":['), F.array_join(rules, ","), F.lit('],"publication":{"title":"Book","license":"ORC","remaster":'), (size % 2 == 0).cast("string"), F.lit("}}"),
    )
    one = lambda x: F.regexp_replace(x, r"\[(\"(?:[^\"\\]|\\.)*\")\]", "$1")
    # lists of one text stand for texts, but for traits, which have two
    entry = F.concat(F.lit('{"_id":"p'), key, F.lit('","name":'), one(F.to_json(F.array("p_name"))), F.lit(',"type":"feat","system":'), one(system), F.lit("}"))
    # parts are short and entries long, so parts are dealt to all tasks before
    return table(spark, sf, "part").repartition("p_partkey").select(F.lit("parts").alias("pack"), F.col("p_partkey").alias("ordinal"), F.parse_json(entry).alias("v"))


_CANONICAL = (
    "'{\"name\": \"' || p_name || '\", \"system\": {\"category\": \"general\", \"description\": {\"value\": \"' || " + _LINK + " || '\"}, \"level\": {\"value\": ' || p_size || '}, \"publication\": {\"license\": \"ORC\", \"remaster\": ' || (p_size % 2 = 0) || ', \"title\": \"Book\"}, "
    "\"rules\": [{\"key\": \"FlatModifier\", \"selector\": \"ac\", \"type\": \"item\", \"value\": ' || p_size || '}, {\"key\": \"GrantItem\", \"uuid\": \"Compendium.x.Item.p' || p_partkey || '\"}, {\"key\": \"Aura\", \"radius\": ' || p_size || '}, {\"key\": \"Odd\", \"x\": \"' || p_type || '\"}], "
    "\"slug\": \"' || lower(p_type) || '\", \"traits\": {\"value\": [\"' || p_brand || '\", \"common\"]}}, \"type\": \"feat\"}'"
)


@register(
    "chunk_entries",
    f"WITH n AS (SELECT a.*, coalesce(b.p_name, 'next') AS follows FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1) SELECT 'parts:p' || p_partkey AS id, p_name AS name, p_size AS level, 4 AS raw_rules_count, substr(sha256({_CANONICAL}), 1, 16) AS source_hash, "
    "'feat: ' || p_name || ' (' || lower(p_type) || ')' || chr(10) || 'Level: ' || p_size || chr(10) || 'Traits: ' || p_brand || ', common' || chr(10) || 'Category: general' || chr(10) || chr(10) || 'Description:' || chr(10) || 'See ' || follows || ' & rest' || chr(10) || chr(10) || 'Mechanical Effects:' || chr(10) || "
    "'- +' || p_size || ' item to ac' || chr(10) || '- Grants item: ' || p_name || chr(10) || '- Aura radius ' || p_size || ' ft' || chr(10) || '- [Odd: {\"key\": \"Odd\", \"x\": \"' || p_type || '\"}]' || chr(10) || chr(10) || 'Related: ' || CASE WHEN follows = p_name THEN p_name WHEN follows < p_name THEN follows || ', ' || p_name ELSE p_name || ', ' || follows END || chr(10) || chr(10) || "
    "'Source: Book ' || CASE WHEN p_size % 2 = 0 THEN '[remaster] ' ELSE '' END || '(ORC)' AS text FROM n",
)
def chunk_entries(spark, sf):
    entries = materialised(_entries(spark, sf), "entries")
    return K.entry_chunks(entries, K.names_of(entries)).select("id", "name", "level", "raw_rules_count", "source_hash", "text")


@register(
    "entry_references",
    "SELECT 'p' || a.p_partkey AS item_id, coalesce(b.p_name, 'next') AS name, 'p' || (a.p_partkey + 1) AS uuid, 'link' AS kind FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1 UNION ALL SELECT 'p' || p_partkey, p_name, 'p' || p_partkey, 'rule: GrantItem' FROM part",
)
def entry_references(spark, sf):
    entries = _entries(spark, sf)
    entries = materialised(entries, "entries")
    names, id_ = K.names_of(entries), F.try_variant_get("v", "$._id", "string").alias("item_id")
    rows = entries.select(id_, F.try_variant_get("v", "$.system.description.value", "string").alias("html"))
    rules = entries.select(id_, F.posexplode(F.try_variant_get("v", "$.system.rules", "array<variant>")).alias("ordinal", "rule"))
    links = K.links_of(rows, names, "item_id", "html").select("item_id", "name", "uuid", F.lit("link").alias("kind"))
    return links.union(K.rule_links(rules, names, "item_id").select("item_id", "name", "uuid", F.col("context").alias("kind")))


_PLAIN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g'))"""


@register(
    "chunk_pages",
    f"SELECT 'site:j' || page_id || '_page_0' AS id, url || ' — First' AS name, 'Journal: ' || url || chr(10) || 'Page: First' || chr(10) || chr(10) || {_PLAIN} AS text FROM pages WHERE {_PLAIN} <> '' "
    "UNION ALL SELECT 'site:j' || page_id || '_page_2', url || ' — Page 3', 'Journal: ' || url || chr(10) || 'Page: Page 3' || chr(10) || chr(10) || 'to ' || (SELECT url FROM pages q WHERE q.page_id = 0) || chr(10) || chr(10) || 'Related: ' || (SELECT url FROM pages q WHERE q.page_id = 0) FROM pages",
)
def chunk_pages(spark, sf):
    pages = F.array(
        F.struct(F.lit("First").alias("name"), F.struct(F.col("html").alias("content")).alias("text")), F.struct(F.lit("Blank").alias("name"), F.struct(F.lit("<p> </p>").alias("content")).alias("text")),
        F.struct(F.lit(None).cast("string").alias("name"), F.struct(F.lit("<p>to @UUID[site.Item.j0]</p>").alias("content")).alias("text")),
    )
    entry = F.to_json(F.struct(F.concat(F.lit("j"), F.col("page_id").cast("string")).alias("_id"), F.col("url").alias("name"), pages.alias("pages")))
    entries = table(spark, sf, "pages").select(F.lit("site").alias("pack"), F.col("page_id").alias("ordinal"), F.parse_json(entry).alias("v"))
    return K.page_chunks(entries, K.names_of(entries), strip_listed).select("id", "name", "text")


@register(
    "spoken_formulas",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '+' || p_size || ' at level 5+ (else 1)' WHEN 1 THEN 'maximum of 1, character level times ' || p_size WHEN 2 THEN 'negative spell rank' ELSE 'AC' END AS said FROM part",
)
def spoken_formulas(spark, sf):
    from scriptorium.functions.expressions import formula_words, path_words

    way, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    asked = F.when(way == 0, F.concat(F.lit("ternary(gte(@actor.level,5),"), size, F.lit(",1)"))).when(way == 1, F.concat(F.lit("max(1, @actor.level * "), size, F.lit(")"))).otherwise("-1 * @spell.rank")
    return table(spark, sf, "part").select("p_partkey", F.when(way == 3, path_words(F.lit("system.attributes.ac.value"))).otherwise(formula_words(asked)).alias("said"))

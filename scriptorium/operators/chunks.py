"""Entries of packs as text chunks: rules in words, fields by type, pages of journals, references.

Entries are JSON texts, read as VARIANT.  Rules and references are rows while they
are worked on, so names are joined to them by identifier, and no map of names is
ever sent around.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.expressions import formula_words, path_words, signed
from scriptorium.functions.templates import filled, lines, strings, there, value
from scriptorium.functions.text import strip_html
from scriptorium.sources.shared import materialised

# Sentences of rule elements
RULES = {
    "FlatModifier": "{value~signed} {type} to {selector}< ({label})>",
    "Immunity": "Immunity to {type|unknown}",
    "Resistance": "Resistance {value} to {type}",
    "Weakness": "Weakness {value} to {type}",
    "RollOption": "Roll option: {option}<toggleable? [toggleable]>",
    "GrantItem": "Grants< (at level {level})> item: {uuid}",
    "ChoiceSet": "Choice set: {flag}",
    "DamageDice": "<diceNumber?+{diceNumber}{dieSize} {damageType} damage >< to {selector}>",
    "Strike": "Strike: {label|unlabeled}< ({category})>< [{group}]>< traits: {traits,}><damage.base? damage: {damage.base.dice}{damage.base.die} {damage.base.damageType}>",
    "BaseSpeed": "Base speed: {value} ft ({selector})",
    "Sense": "Sense: {selector}< ({acuity})>< range {range} ft>",
    "ActiveEffectLike": "Effect: {mode} {path~path} to {value~formula}",
    "ItemAlteration": "Alter {itemType}: {mode} {property} = {value}",
    "AdjustDegreeOfSuccess": "Adjust degree of success on {selector}: ",
    "AdjustModifier": "Adjust modifier '{slug}' on {selector}: {mode} by {value}",
    "MartialProficiency": "Martial proficiency< same as {sameAs}>< rank {rank}>< groups: {groups,}>",
    "CriticalSpecialization": "Critical specialization: ",
    "Aura": "Aura radius {radius|?} ft",
    "EphemeralEffect": "Ephemeral effect: {uuid} on {selectors,}",
    "CraftingAbility": "Crafting ability<isDailyPrep? [daily prep]>",
    "CreatureSize": "Size: {value}",
    "DexterityModifierCap": "Dexterity modifier cap: {value}",
    "TokenLight": "Token light: {value}",
    "SpecialResource": "Special resource: {slug} max {max}",
    "FastHealing": "Fast healing {value} ({details})",
    "MultipleAttackPenalty": "Multiple attack penalty: {value}",
    "LoseHitPoints": "Lose {value~formula} HP",
    "TempHP": "Temporary HP: {value~formula}",
    "SubstituteRoll": "Substitute roll on {selector}",
    "RollTwice": "Roll twice on {selector} ({keep})",
    "Note": "",
    "ActorTraits": "",
}
# Lines of entries by type, in order
FIELDS = {
    "condition": ["<Condition Group: {group}>", "<Overrides: {overrides,}>", "<duration.unit?Duration: {duration.value} {duration.unit}>", "<value.isValued?Valued: yes (stacks)>"],
    "spell": [
        "<Traditions: {traditions.value,}>", "<time?Cast: {time.value} {time.unit}>", "<defense.save?Save: {defense.save.statistic}><defense.save.basic? (basic)>", "@damage", "@heightening",
        "<Range: {range.value}>", "<Target: {target.value}>", "<Area: {area.value} {area.type}>", "<Duration: {duration.value}>",
    ],
    "feat": ["<Category: {category}>", "@subfeatures"],
    "class": ["<Key Ability: {keyAbility.value,}>", "<HP: {hp}>", "<Perception: {perception.value}>", "@saves", "@skills"],
    "ancestry": ["<HP: {hp}>", "<Size: {size}>", "<Speed: {speed}>", "<Ability Boosts: {boosts.default,}>", "<Ability Flaws: {flaws.default,}>"],
    "heritage": ["<Ancestry: {ancestry.name}>"],
    "background": ["<Ability Boosts: {boosts.default,}>", "<Trained Skills: {trainedSkills.value,}>", "@granted"],
}
CALLS = {"signed": signed, "formula": formula_words, "path": path_words}
LINK = r"@UUID\[([^\]]+)\](?:\{([^}]*)\})?"
BARE = r"Compendium\.[^\s]+\.Item\.([A-Za-z0-9]+)"


def _pairs(v: Column, path: str) -> Column:
    """array<struct<key, value>> of an object's members, by key."""
    held = F.coalesce(F.try_variant_get(v, f"$.{path}", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return F.transform(F.array_sort(F.map_keys(held)), lambda k: F.named_struct(F.lit("key"), k, F.lit("value"), F.element_at(held, k)))


def _joined(items: Column, lead: str, sep: str = ", ") -> Column:
    """lead and the items, or nothing without any."""
    some = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(some) > 0, F.concat(F.lit(lead), F.array_join(some, sep))).otherwise(F.lit(""))


def _items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))


def rule_text(rule: Column) -> Column:
    """A rule element in words; an unknown one as `[key: JSON]`, cut at 120 characters."""
    key = F.coalesce(value(rule, "key"), F.lit(""))
    of = {k: filled(rule, t, CALLS) for k, t in RULES.items()}
    option = lambda c: F.coalesce(value(c, "value"), value(c, "label"), F.lit(""))
    of["RollOption"] = F.concat(of["RollOption"], _joined(F.transform(_items(rule, "suboptions"), option), " choices: "))
    label = lambda c: F.when(F.schema_of_variant(c).startswith("OBJECT"), F.coalesce(value(c, "label"), value(c, "value"), F.to_json(c))).otherwise(F.try_variant_get(c, "$", "string"))
    choices = F.slice(F.transform(_items(rule, "choices"), label), 1, 8)
    of["ChoiceSet"] = F.concat(of["ChoiceSet"], F.when(F.size(choices) > 0, F.concat(F.lit(" (options: "), F.array_join(choices, ", "), F.lit(")"))).otherwise(F.lit("")))
    changes = F.transform(_pairs(rule, "adjustment"), lambda p: F.concat(p["key"], F.lit(" -> "), F.try_variant_get(p["value"], "$", "string")))
    of["AdjustDegreeOfSuccess"] = F.concat(of["AdjustDegreeOfSuccess"], F.array_join(changes, ", "))
    of["CriticalSpecialization"] = F.concat(of["CriticalSpecialization"], F.when(there(rule, "groups"), F.array_join(strings(rule, "groups"), ", ")).otherwise(F.lit("all weapons")))
    of["Aura"] = F.concat(of["Aura"], F.array_join(F.transform(_items(rule, "effects"), lambda e: F.concat(F.lit(" effect: "), F.coalesce(value(e, "uuid"), F.lit("")))), ""))
    of["CraftingAbility"] = F.concat(of["CraftingAbility"], F.when(there(rule, "craftableItems"), F.concat(F.lit(" items: "), F.size(_items(rule, "craftableItems")).cast("string"), F.lit(" entries"))).otherwise(F.lit("")))
    outcome = F.when(there(rule, "outcome"), F.concat(F.lit("when "), F.array_join(strings(rule, "outcome"), "/")))
    of["Note"] = _joined(F.array(value(rule, "title"), value(rule, "text"), F.when(there(rule, "selector"), F.concat(F.lit("on "), value(rule, "selector"))), outcome), "", " — ")
    of["ActorTraits"] = _joined(F.array(_joined(strings(rule, "add"), "Add traits: "), _joined(strings(rule, "remove"), "Remove traits: ")), "", "; ")
    of["DamageDice"] = F.trim(F.regexp_replace(of["DamageDice"], " +to ", " to "))
    known = F.coalesce(*[F.when(key == k, text) for k, text in of.items()])
    return F.coalesce(known, F.concat(F.lit("["), key, F.lit(": "), F.substring(spaced_json(rule), 1, 120), F.lit("]")))


def spaced_json(v: Column) -> Column:
    """A variant as JSON with sorted keys and a blank after each comma and colon."""
    parts = F.regexp_extract_all(F.to_json(v), F.lit(r'"(?:[^"\\]|\\.)*"|[^",:]+|[,:]'), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.isin(",", ":"), F.concat(p, F.lit(" "))).otherwise(p)), "")


def entry_hash(entry: Column) -> Column:
    """First 16 digits of the SHA-256 of an entry's name, type and system (and pages, of journals), as JSON of sorted keys."""
    get = lambda path: F.try_variant_get(entry, path, "variant")
    part = lambda name, path, none: F.concat(F.lit(f'"{name}": '), F.coalesce(spaced_json(get(path)), F.lit(none)))
    page = lambda p: F.concat(F.lit('{"name": '), F.coalesce(spaced_json(F.try_variant_get(p, "$.name", "variant")), F.lit('""')), F.lit(', "text": '), F.coalesce(spaced_json(F.try_variant_get(p, "$.text", "variant")), F.lit("{}")), F.lit("}"))
    pages = F.concat(F.lit('"pages": ['), F.array_join(F.transform(_items(entry, "pages"), page), ", "), F.lit("]"))
    journal = get("$.pages").isNotNull() & get("$.system").isNull()
    whole = F.concat_ws(", ", part("name", "$.name", '""'), F.when(journal, pages), part("system", "$.system", "{}"), part("type", "$.type", '""'))
    return F.substring(F.sha2(F.concat(F.lit("{"), whole, F.lit("}")), 256), 1, 16)


def names_of(entries: DataFrame) -> DataFrame:
    """(item_id, resolved): names by identifier, and by the identifier of the compendium's source where no entry has that; entries: (pack, ordinal, v)."""
    source = value(F.col("v"), "_stats.compendiumSource")
    own = entries.select(value(F.col("v"), "_id").alias("item_id"), F.lit(0).alias("way"), "pack", "ordinal", value(F.col("v"), "name").alias("resolved"))
    lent = entries.filter(F.contains(source, F.lit(".Item."))).select(F.substring_index(source, ".Item.", -1).alias("item_id"), F.lit(1).alias("way"), "pack", "ordinal", value(F.col("v"), "name").alias("resolved"))
    # of entries with one identifier the last counts; of those that only lend it, the first
    order = F.struct("way", F.when(F.col("way") == 0, -F.col("ordinal")).otherwise(F.col("ordinal")), "pack")
    named = own.union(lent).filter("item_id is not null and item_id <> ''").groupBy("item_id").agg(F.min_by("resolved", order).alias("resolved"))
    return materialised(named, "names")  # joined several times


def _item(uuid: Column) -> Column:
    return F.when(F.contains(uuid, F.lit(".Item.")), F.substring_index(uuid, ".Item.", -1)).otherwise(uuid)


def rewritten(rows: DataFrame, names: DataFrame, key: str, text: str, bare: bool = False) -> DataFrame:
    """rows with links in `text` as names: what the identifier resolves to, else the link's label, else the identifier; bare: also identifiers outside links."""
    for pattern in (LINK, BARE) if bare else (LINK,):
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        links = rows.select(key, F.posexplode(whole).alias("pos", "link"))
        label = F.nullif(F.regexp_extract("link", LINK, 2), F.lit("")) if pattern == LINK else F.col("link")
        links = links.select(key, "pos", _item(F.regexp_extract("link", pattern, 1)).alias("item_id"), label.alias("label"))
        named = links.join(names, "item_id", "left").select(key, F.struct("pos", F.coalesce(F.nullif("resolved", F.lit("")), "label", "item_id").alias("name")).alias("x"))
        named = named.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("_names"))
        between = F.split(F.col(text), pattern, -1)
        glued = F.array_join(F.zip_with(between, F.col("_names.name"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        rows = rows.join(named, key, "left").withColumn(text, F.when(F.col("_names").isNotNull(), glued).otherwise(F.col(text))).drop("_names")
    return rows


def links_of(rows: DataFrame, names: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, name, uuid, context) of the links in HTML texts; context: 200 characters of the plain text."""
    found = rows.select(key, F.substring(strip_html(F.col(html)), 1, 200).alias("context"), F.posexplode(F.regexp_extract_all(html, F.lit(LINK), F.lit(0))).alias("pos", "link"))
    found = found.select(key, "context", "pos", _item(F.regexp_extract("link", LINK, 1)).alias("uuid"), F.nullif(F.regexp_extract("link", LINK, 2), F.lit("")).alias("label"))
    return found.join(names.withColumnRenamed("item_id", "uuid"), "uuid", "left").select(key, "pos", F.coalesce(F.nullif("resolved", F.lit("")), "label", "uuid").alias("name"), "uuid", "context")


def rule_links(rules: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, ordinal, name, uuid, context) of what rule elements refer to; rules: (key, ordinal, rule)."""
    kind = F.coalesce(value(F.col("rule"), "key"), F.lit(""))
    own = F.array(*[F.struct(value(F.col("rule"), p).alias("uuid"), F.concat(F.lit("rule: "), kind).alias("context")) for p in ("uuid", "compendiumSource")])
    aura = F.transform(_items(F.col("rule"), "effects"), lambda e: F.named_struct(F.lit("uuid"), value(e, "uuid"), F.lit("context"), F.concat(F.lit("aura effect: "), kind)))
    found = rules.select(key, "ordinal", F.explode(F.concat(own, aura)).alias("x")).filter("x.uuid is not null and x.uuid <> ''").select(key, "ordinal", _item(F.col("x.uuid")).alias("uuid"), "x.context")
    return found.join(names.withColumnRenamed("item_id", "uuid"), "uuid", "left").select(key, "ordinal", F.coalesce(F.nullif("resolved", F.lit("")), "uuid").alias("name"), "uuid", "context")


def publication(v: Column) -> dict[str, Column]:
    """title, license and remaster of the owning publication: the entry's, or that of its details, if it has a title."""
    pick = lambda name: F.when(there(v, "system.publication.title"), value(v, f"system.publication.{name}")).when(there(v, "system.details.publication.title"), value(v, f"system.details.publication.{name}"))
    return {"title": pick("title"), "license": pick("license"), "remaster": F.when(pick("remaster") == "True", True).when(pick("remaster") == "False", False)}


def _typed(v: Column, kind: str) -> Column:
    """The lines of a type's own fields; v: the entry's system."""
    heightened = [F.when(there(v, "heightening.type"), value(v, "heightening.type")), F.when(there(v, "heightening.interval"), filled(v, "every {heightening.interval} rank(s)"))]
    more = F.transform(_pairs(v, "heightening.damage"), lambda p: F.concat(F.lit("+"), F.try_variant_get(p["value"], "$", "string"), F.lit(" damage at rank "), p["key"]))
    area = F.array(F.when(there(v, "heightening.area"), filled(v, "+{heightening.area} ft area")))
    formula = lambda p: F.when(there(p["value"], "formula"), F.concat(value(p["value"], "formula"), F.lit(" "), F.coalesce(value(p["value"], "type"), F.lit(""))))
    told = lambda p: F.when(there(p["value"], "value"), F.concat(p["key"], F.lit(" "), value(p["value"], "value")))
    special = {
        "@damage": F.array(_joined(F.transform(_pairs(v, "damage"), formula), "Damage: ")),
        "@heightening": F.array(_joined(F.concat(F.array(*heightened), more, area), "Heightening: ", "; ")),
        "@subfeatures": F.transform(F.filter(_pairs(v, "subfeatures"), lambda p: ~F.to_json(p["value"]).isin("null", '""', "0", "false", "[]", "{}")), lambda p: F.concat(F.lit("Subfeature ("), p["key"], F.lit("): "), F.substring(spaced_json(p["value"]), 1, 200))),
        "@saves": F.array(_joined(F.transform(_pairs(v, "savingThrows"), told), "Saves: ")),
        "@skills": F.array(_joined(F.concat(F.transform(F.filter(_pairs(v, "trainedSkills"), lambda p: p["key"] != "value"), told), strings(v, "trainedSkills.value")), "Trained Skills: ")),
        "@granted": F.transform(F.filter(_pairs(v, "items"), lambda p: there(p["value"], "uuid")), lambda p: F.concat(F.lit("Granted: "), value(p["value"], "uuid"))),
    }
    parts = [special[t] if t.startswith("@") else lines(v, [t]) for t in FIELDS[kind]]
    return F.filter(F.concat(*parts), lambda x: x != "")


def page_chunks(entries: DataFrame, names: DataFrame, plain: Callable[[Column], Column] = strip_html) -> DataFrame:
    """(id, name, type, pack, text, source_hash, license, remaster, publication_title) of journals' pages that have text; entries: (pack, ordinal, v); plain: HTML to text."""
    v = F.col("v")
    journals = entries.filter((F.coalesce(value(v, "type"), F.lit("")) == "") & F.try_variant_get(v, "$.pages", "variant").isNotNull() & F.try_variant_get(v, "$.system", "variant").isNull())
    rows = journals.select("pack", v.alias("entry"), F.posexplode(_items(v, "pages")).alias("i", "page"))
    title = F.coalesce(value(F.col("page"), "name"), F.concat(F.lit("Page "), (F.col("i") + 1).cast("string")))
    text = F.try_variant_get("page", "$.text", "variant")
    html = F.when(F.schema_of_variant(text).startswith("OBJECT"), F.coalesce(value(F.col("page"), "text.content"), F.lit(""))).otherwise(F.coalesce(value(F.col("page"), "text"), F.lit("")))
    e = F.col("entry")
    id_ = F.concat("pack", F.lit(":"), value(e, "_id"), F.lit("_page_"), F.col("i").cast("string"))
    rows = rows.select(id_.alias("id"), "pack", F.coalesce(value(e, "name"), F.lit("")).alias("journal"), title.alias("title"), html.alias("html"), entry_hash(e).alias("source_hash"), *[c.alias({"title": "publication"}.get(k, k)) for k, c in publication(e).items()])
    plain = rewritten(rows.withColumn("plain", plain(F.col("html"))), names, "id", "plain").filter(F.trim("plain") != "")
    related = links_of(rows, names, "id", "html").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("related"))
    body = F.concat_ws("\n", F.concat(F.lit("Journal: "), "journal"), F.concat(F.lit("Page: "), "title"), F.lit(""), "plain", F.when(F.col("related").isNotNull(), F.concat(F.lit("\nRelated: "), F.array_join("related", ", "))))
    out = plain.join(related, "id", "left")
    return out.select("id", F.concat("journal", F.lit(" — "), "title").alias("name"), F.lit("journal_page").alias("type"), "pack", body.alias("text"), "source_hash", F.coalesce("license", F.lit("NONE")).alias("license"), "remaster", F.col("publication").alias("publication_title"))


def entry_chunks(entries: DataFrame, names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(id, name, type, pack, slug, level, traits, text, raw_rules_count, source_hash, license, remaster, publication_title) of entries that are no journals.

    entries: (pack, ordinal, v); aliases: (old, new) names, of which an entry with
    the new one tells the old.
    """
    v = F.col("v")
    level = F.coalesce(F.try_variant_get(v, "$.system.level.value", "int"), F.try_variant_get(v, "$.system.level", "int"))
    kind, actions = F.coalesce(value(v, "type"), F.lit("")), F.coalesce(value(v, "system.actions.value"), F.lit(""))
    action = F.coalesce(value(v, "system.actionType.value"), F.lit(""))
    cost = F.when((action == "action") & there(v, "system.actions.value"), F.concat(actions, F.lit(" action"), F.when(actions == "1", "").otherwise("s"))).when(action != "", action)
    wanted = F.transform(_items(v, "system.prerequisites.value"), lambda p: F.coalesce(value(p, "value"), F.try_variant_get(p, "$", "string")))
    rows = entries.filter(~((kind == "") & F.try_variant_get(v, "$.pages", "variant").isNotNull() & F.try_variant_get(v, "$.system", "variant").isNull()))
    rows = rows.select(
        F.concat("pack", F.lit(":"), F.coalesce(value(v, "_id"), F.lit(""))).alias("id"), F.coalesce(value(v, "name"), F.lit("")).alias("own_name"), kind.alias("type"), "pack", F.coalesce(value(v, "system.slug"), F.lit("")).alias("slug"),
        level.alias("level"), strings(v, "system.traits.value").alias("traits"), cost.alias("cost"), wanted.alias("wanted"), F.coalesce(value(v, "system.description.value"), F.lit("")).alias("html"),
        F.try_variant_get(v, "$.system", "variant").alias("system"), _items(v, "system.rules").alias("rules"), entry_hash(v).alias("source_hash"), *[c.alias(k) for k, c in publication(v).items()],
    )
    rows = materialised(rows, "entries")  # an entry is read from its JSON once
    if aliases is not None:
        old = aliases.groupBy(F.lower("new").alias("_new")).agg(F.min(F.lower(F.trim("old"))).alias("old"))
        rows = rows.join(old, F.lower("own_name") == F.col("_new"), "left").drop("_new")
    else:
        rows = rows.withColumn("old", F.lit(None).cast("string"))
    rows = rows.withColumn("name", F.when(F.col("old").isNotNull(), F.concat("own_name", F.lit(" (formerly "), "old", F.lit(")"))).otherwise(F.col("own_name")))
    rules = rows.select("id", F.posexplode("rules").alias("ordinal", "rule"))
    spoken = rules.select("id", "ordinal", rule_text(F.col("rule")).alias("said")).withColumn("row", F.concat_ws("#", "id", "ordinal"))
    spoken = rewritten(materialised(spoken, "spoken"), names, "row", "said", bare=True).select("id", "ordinal", F.trim("said").alias("said")).filter("said <> ''")
    spoken = spoken.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "said"))).alias("said"))
    plain = rewritten(materialised(rows.select("id", strip_html(F.col("html")).alias("plain")), "plain"), names, "id", "plain")
    related = links_of(rows, names, "id", "html").select("id", "name").union(rule_links(rules, names, "id").select("id", "name"))
    related = related.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("related"))
    out = rows.join(plain, "id", "left").join(spoken, "id", "left").join(related, "id", "left")
    typed = F.coalesce(*[F.when(F.col("type") == k, _typed(F.col("system"), k)) for k in FIELDS], F.array().cast("array<string>"))
    said = lambda lead, c: F.when(F.coalesce(c != "", F.lit(False)), F.concat(F.lit(lead), c))
    source = _joined(F.array("title", F.when(F.col("remaster"), "[remaster]"), F.when(F.col("license") != "", F.concat(F.lit("("), "license", F.lit(")")))), "\nSource: ", " ")
    parts = F.concat(
        F.array(
            F.concat("type", F.lit(": "), "name", F.when(F.col("slug") != "", F.concat(F.lit(" ("), "slug", F.lit(")"))).otherwise(F.lit(""))),
            said("Also known as: ", F.col("old")), said("Level: ", F.col("level").cast("string")), said("Action: ", F.col("cost")), said("Traits: ", F.array_join("traits", ", ")), said("Prerequisites: ", F.array_join("wanted", "; ")),
        ),
        typed,
        F.array(
            said("\nDescription:\n", F.col("plain")), F.when(F.col("said").isNotNull(), F.concat(F.lit("\nMechanical Effects:\n- "), F.array_join(F.col("said.said"), "\n- "))),
            F.when(F.col("related").isNotNull(), F.concat(F.lit("\nRelated: "), F.array_join("related", ", "))), F.nullif(source, F.lit("")),
        ),
    )
    text = F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n")
    return out.select("id", "name", "type", "pack", "slug", "level", "traits", text.alias("text"), F.size("rules").alias("raw_rules_count"), "source_hash", F.when(F.col("title").isNotNull(), F.coalesce("license", F.lit("OGL"))).otherwise(F.lit("OGL")).alias("license"), "remaster", F.col("title").alias("publication_title"))

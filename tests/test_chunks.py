"""Rule elements, fields and references against texts written out by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.expressions import formula_words, signed
from scriptorium.operators import chunks

RULES = [
    ({"key": "FlatModifier", "value": 2, "type": "status", "selector": "ac", "label": "Shield"}, "+2 status to ac (Shield)"),
    ({"key": "FlatModifier", "value": -1.5, "type": "item", "selector": "will"}, "-1.5 item to will"),
    ({"key": "FlatModifier", "value": "ternary(gte(@actor.level,10),2,1)", "type": "item", "selector": "all"}, "+2 at level 10+ (else 1) item to all"),
    ({"key": "Immunity"}, "Immunity to unknown"),
    ({"key": "Resistance", "value": 5, "type": "fire"}, "Resistance 5 to fire"),
    ({"key": "RollOption", "option": "x", "toggleable": True, "suboptions": [{"value": "a"}, {"label": "b"}]}, "Roll option: x [toggleable] choices: a, b"),
    ({"key": "GrantItem", "uuid": "u", "level": 3}, "Grants (at level 3) item: u"),
    ({"key": "ChoiceSet", "flag": "f", "choices": ["a", {"label": "b"}, {"value": "c"}]}, "Choice set: f (options: a, b, c)"),
    ({"key": "ChoiceSet", "flag": "f", "choices": {"query": 1}}, "Choice set: f"),
    ({"key": "Note", "title": "T", "text": "x", "selector": "s", "outcome": ["success", "failure"]}, "T — x — on s — when success/failure"),
    ({"key": "DamageDice", "diceNumber": 1, "dieSize": "d6", "damageType": "fire", "selector": "strike"}, "+1d6 fire damage to strike"),
    ({"key": "DamageDice", "selector": "strike"}, "to strike"),
    ({"key": "Strike", "category": "unarmed", "group": "brawling", "traits": ["agile", "finesse"], "damage": {"base": {"dice": 1, "die": "d4", "damageType": "slashing"}}}, "Strike: unlabeled (unarmed) [brawling] traits: agile, finesse damage: 1d4 slashing"),
    ({"key": "Sense", "selector": "scent", "acuity": "imprecise", "range": 30}, "Sense: scent (imprecise) range 30 ft"),
    ({"key": "ActiveEffectLike", "mode": "upgrade", "path": "system.saves.will.rank", "value": "max(1,@actor.level)"}, "Effect: upgrade Will save proficiency to maximum of 1, character level"),
    ({"key": "AdjustDegreeOfSuccess", "selector": "s", "adjustment": {"failure": "one-degree-better"}}, "Adjust degree of success on s: failure -> one-degree-better"),
    ({"key": "MartialProficiency", "rank": 2, "groups": ["sword", "bow"]}, "Martial proficiency rank 2 groups: sword, bow"),
    ({"key": "CriticalSpecialization"}, "Critical specialization: all weapons"),
    ({"key": "Aura", "effects": [{"uuid": "a"}, {"uuid": "b"}]}, "Aura radius ? ft effect: a effect: b"),
    ({"key": "CraftingAbility", "isDailyPrep": True, "craftableItems": [1, 2]}, "Crafting ability [daily prep] items: 2 entries"),
    ({"key": "ActorTraits", "add": ["undead"], "remove": ["living"]}, "Add traits: undead; Remove traits: living"),
    ({"key": "TempHP", "value": "2 * @spell.rank"}, "Temporary HP: 2 times spell rank"),
    ({"key": "New", "b": [1, "x, y: z"], "a": None}, '[New: {"a": null, "b": [1, "x, y: z"], "key": "New"}]'),
]


def test_rules_in_words(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(RULES)], "i int, r string").select("i", F.parse_json("r").alias("rule"))
    got = {r.i: r.said for r in df.select("i", chunks.rule_text(F.col("rule")).alias("said")).collect()}
    assert [got[i] for i in range(len(RULES))] == [text for _, text in RULES]


@pytest.mark.parametrize("text, want", [
    ("@actor.level", "character level"),
    ("ternary(@item.badge.value,floor(@actor.level/2),0)", "floor(character level/2) if the condition value else 0"),
    # of choices in each other, the one that is shallow enough is spoken
    ("ternary(lt(abs(1),2),ternary(gte(@actor.level,7),3,2),1)", "ternary(lt(abs(1),2),+3 at level 7+ (else 2),1)"),
    ("min(5,max(1,2))", "minimum of 5, maximum of 1, 2"),
    ("2*@spell.level  + -1 * x", "2 times spell level + negative x"),
    ("ternary(a,b", "ternary(a,b"),
])
def test_formulas(spark, text, want):
    assert spark.range(1).select(formula_words(F.lit(text))).first()[0] == want


def test_signs(spark):
    df = spark.createDataFrame([("3",), ("0",), ("1e3",), ("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(signed(F.col("t"))).collect()] == ["+3", "+0", "+1000", "abc", None]


def test_entries(spark):
    entries = [
        {"_id": "a", "name": "Fury", "type": "condition", "system": {"slug": "fury", "group": "mind", "overrides": ["x", "y"], "value": {"isValued": True}, "level": 2, "description": {"value": "@UUID[Compendium.p.Item.b]{bee} and @UUID[q.Item.zz]{zed} &copy;"},
         "details": {"publication": {"title": "Old", "license": "OGL"}}}},
        {"_id": "b", "name": "Bolt", "type": "spell", "system": {"traditions": {"value": ["arcane"]}, "time": {"value": 2, "unit": "actions"}, "defense": {"save": {"statistic": "reflex", "basic": True}}, "damage": {"0": {"formula": "2d6", "type": "fire"}}, "heightening": {"type": "interval", "interval": 1, "damage": {"0": "2d6"}},
         "range": {"value": "30 feet"}, "area": {"value": 20, "type": "burst"}, "actionType": {"value": "action"}, "actions": {"value": 2}, "prerequisites": {"value": [{"value": "p"}, "q"]}}},
        {"_id": "c", "name": "Rite", "type": "class", "system": {"keyAbility": {"value": ["str"]}, "hp": 10, "savingThrows": {"will": {"value": 2}}, "trainedSkills": {"value": ["arcana"], "lore": {"value": 1}}}, "_stats": {"compendiumSource": "Compendium.p.Item.zz"}},
        {"_id": "d", "name": "Log", "pages": [{"name": "One", "text": "plain"}, {"text": {"content": " "}}]},
    ]
    df = spark.createDataFrame([("p", i, json.dumps(e)) for i, e in enumerate(entries)], "pack string, ordinal int, e string").select("pack", "ordinal", F.parse_json("e").alias("v"))
    names = chunks.names_of(df)
    aliases = spark.createDataFrame([("Rage ", "fury")], "old string, new string")
    got = {r.id: r for r in chunks.entry_chunks(df, names, aliases).collect()}
    assert set(got) == {"p:a", "p:b", "p:c"}
    assert got["p:a"].text == "condition: Fury (formerly rage) (fury)\nAlso known as: rage\nLevel: 2\nCondition Group: mind\nOverrides: x, y\nValued: yes (stacks)\n\nDescription:\nBolt and Rite ©\n\nRelated: Bolt, Rite\n\nSource: Old (OGL)"
    assert got["p:b"].text == "spell: Bolt\nAction: 2 actions\nPrerequisites: p; q\nTraditions: arcane\nCast: 2 actions\nSave: reflex (basic)\nDamage: 2d6 fire\nHeightening: interval; every 1 rank(s); +2d6 damage at rank 0\nRange: 30 feet\nArea: 20 burst"
    assert got["p:c"].text == "class: Rite\nKey Ability: str\nHP: 10\nSaves: will 2\nTrained Skills: lore 1, arcana"
    assert (got["p:a"].publication_title, got["p:b"].license, got["p:b"].remaster) == ("Old", "OGL", None)
    pages = chunks.page_chunks(df, names).collect()
    assert [(r.id, r.name, r.text, r.license) for r in pages] == [("p:d_page_0", "Log — One", "Journal: Log\nPage: One\n\nplain", "NONE")]

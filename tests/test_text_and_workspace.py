"""Text functions against Python's own, and workspace rules against plain loops."""

from __future__ import annotations

import html
import random
import re

from pyspark.sql import functions as F

from scriptorium.functions import identity, text
from scriptorium.operators import index, layout, workspace


def test_entities_are_those_of_the_standard_library(spark):
    rng = random.Random(1)
    bits = "&amp; &lt; &amp;lt; &notit; &not &copy &copy;x &nbsp; &#39; &#x41; &#65 &#128; &#0; &#xD800; &#x110000; &#99999999999; &#x1F600; &bogus; & &; &hellip; abc é &NotEqualTilde; &#11; &#xfffe; &ampamp; &#x; &#; &#13; &#129;".split(" ")
    rows = [("".join(rng.choice(bits) for _ in range(rng.randint(0, 6))),) for _ in range(300)]
    got = spark.createDataFrame(rows, "t string").select("t", text.unescape(F.col("t")).alias("u")).collect()
    assert all(r.u == html.unescape(r.t) for r in got)


def test_numbers_have_no_letters_beside_them(spark):
    rng = random.Random(2)
    bits = ["2d6 + 3", "2d6+3", "3.5", "3.5x", "2.0.1", "1ST", "21stx", "x5", "-4", "10d4-1", "1d6-", "é5", "5é", "3.", "_4", " "]
    want = re.compile(r"(?<!\w)(?:\d+d\d+(?:\s*[+-]\s*\d+)?|\d+(?:\.\d+)?(?:st|nd|rd|th)?)(?!\w)", re.IGNORECASE)
    rows = [(" ".join(rng.choice(bits) for _ in range(4)),) for _ in range(200)]
    got = spark.createDataFrame(rows, "t string").select("t", text.numbers(F.col("t")).alias("u")).collect()
    assert all(r.u == [x.lower() for x in want.findall(r.t)] for r in got)


def test_normal_forms(spark):
    row = spark.range(1).select(
        identity.heading_form(F.lit("The “ﬁrst”  Rule—of ◆ Two")).alias("h"), identity.rule_form(F.lit("Source: a + b\r\n\r\nPage: x’s 1d6−2")).alias("r"),
        (identity.rule_hash(F.lit("1d6+2")) == identity.rule_hash(F.lit("1d6-2"))).alias("same"), F.size(identity.wrapped_hashes(F.lit("N"), F.lit("x\n\nDescription:\n a b \n\nSource: y"))).alias("n"),
    ).first()
    assert row == ("the first rule of action two", "a + b x s 1d6 - 2", False, 3)


def test_proposals_that_stay_share_nothing(spark):
    rng = random.Random(3)
    rows = [(run, i, [f"k{k}" for k in range(at, at + width)], width, at) for run in range(6) for i in range(25) for width, at in [(rng.choice([2, 3]), rng.randrange(30))]]
    got = {(r.run, r.i) for r in workspace.disjoint(spark.createDataFrame(rows, "run int, i int, keys array<string>, width int, at int"), "run", "i", "keys", "width", "at").collect()}
    want = set()
    for run in range(6):
        used: set[str] = set()
        for _, i, keys, *_ in sorted((r for r in rows if r[0] == run), key=lambda r: (r[3], r[4], r[1])):
            if not used & set(keys):
                used |= set(keys)
                want.add((run, i))
    assert got == want


def test_packs_find_their_translations():
    packs = ["feats", "animal-companions", "equipment", "pathfinder-society-boons", "bestiary"]
    told = ["pf2e.feats-srd", "pf2e-animalcompanions", "pf2e.equipment", "pf2e.society-boons", "pf2e.other"]
    assert workspace.pack_map(packs, told) == {"feats": "pf2e.feats-srd", "equipment": "pf2e.equipment", "animal-companions": "pf2e-animalcompanions", "pathfinder-society-boons": "pf2e.society-boons"}


def test_an_index_follows_its_table(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "red plate"), (2, "red red ring"), (3, None)], "id long, t string").write.parquet(path)
    first = index.index_of(spark.read.parquet(path), "id", ["t"])
    assert [r.id for r in first.search(["red", "none"], "id", k=5).collect()] == [2, 1]
    spark.createDataFrame([(4, "red")], "id long, t string").write.mode("append").parquet(path)
    second = index.index_of(spark.read.parquet(path), "id", ["t"])
    assert {r.id for r in second.search(["red"], "id").collect()} == {1, 2, 4}
    changed, gone = spark.createDataFrame([(2, "blue")], "id long, t string"), spark.createDataFrame([(2,), (1,)], "id long")
    kept = index.rebuilt(second, changed, gone, "id")
    assert sorted((r.term, r.key) for r in kept.collect()) == [("blue", 2), ("red", 4)]


def test_sections_are_cut_without_lone_headings(spark):
    rows = [(1, k, n, h) for k, (n, h) in enumerate([(5, True), (90, False), (5, True), (20, False), (99, True), (50, False)])]
    got = {r.o: r.part for r in layout.cut_sections(spark.createDataFrame(rows, "s int, o int, n int, h boolean"), "s", "o", "n", "h", 100).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2}

"""Behaviour of operators on small tables with known answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import curation as C
from scriptorium.operators import graph as G
from scriptorium.operators import retrieval as R
from scriptorium.operators import sequences as S
from scriptorium.operators import versions as V


def test_era_preference_keeps_occupied_places(spark):
    df = spark.createDataFrame([(1, "a", False), (2, "x", True), (3, "a", True), (4, "y", None)], "rank int, name string, remaster boolean")
    got = {r["rank"]: r.place for r in R.prefer_era(df, "name", "rank", "remaster").collect()}
    assert got == {1: 3, 3: 1, 2: 2, 4: 4}


def test_name_must_stand_whole(spark):
    ask = lambda q, n: spark.range(1).select(T.holds_name(F.lit(q), F.lit(n)).alias("x")).first().x
    assert ask("cast fireball now", "Fireball")
    assert not ask("cast fireball now", "Fire")
    assert not ask("cast fireball now", "Fireball Rune")
    assert not ask("what is the rule", "The")


def test_reference_blend_lifts_the_referred(spark):
    df = spark.createDataFrame([("a", 0.9, 0), ("b", 0.8, 1)], "id string, s double, refs int")
    got = {r.id: r.adjusted for r in R.blend_references(df, "s", "refs", 0.75).collect()}
    assert got["b"] > got["a"]
    assert {r.adjusted for r in R.blend_references(df.filter("id = 'a'"), "s", "refs", 0.0).collect()} == {1.0}


def test_suffix_join_and_aliases(spark):
    nodes = spark.createDataFrame([("p:x",), ("q:x",), ("p:y",)], "id string")
    edges = spark.createDataFrame([(1, "x"), (2, "p:x"), (3, "y"), (3, "y")], "source int, target string")
    assert {r.id: r.in_degree for r in G.incoming_by_alias(nodes, edges, "id", "target", "source").collect()} == {"p:x": 1, "p:y": 1}
    found = G.suffix_join(edges.select("target").distinct(), nodes, "target", "id")
    assert sorted((r.target, r.id) for r in found.collect()) == [("p:x", "p:x"), ("x", "p:x"), ("x", "q:x"), ("y", "p:y")]


def test_totals_carry_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "g string, x int")
    assert {r.g: r.t for r in df.groupBy("g").agg(C.whole_total(F.col("x"), "t")).collect()} == {"a": None, "b": 2}


def test_digest_ignores_order_but_not_copies(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    one = C.table_digest(a, ["k", "v"]).first().digest
    assert one == C.table_digest(a.orderBy(F.desc("k")), ["k", "v"]).first().digest
    assert one != C.table_digest(a.union(a.limit(1)), ["k", "v"]).first().digest


def test_rows_anchor_at_their_first_word(spark):
    got = spark.range(1).select(S.first_anchored_rows(F.array(*map(F.lit, [10.0, 11.0, 12.1, 12.3, 15.0, 20.0])), 2.2).alias("x")).first().x
    assert got == [[10.0, 11.0, 12.1], [12.3], [15.0], [20.0]]


def test_packing_by_count_and_bytes(spark):
    got = spark.range(1).select(S.greedy_bins(F.array(*[F.lit(500).cast("bigint")] * 70), 32, 65536).alias("x")).first().x
    assert [b.n for b in got] == [32, 32, 6]


def test_snapshot_statuses(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, "d")], "k int, v string")
    assert {r.k: r.status for r in V.snapshot_diff(old, new, "k", "v").collect()} == {1: "unchanged", 2: "changed", 3: "unchanged", 4: "added"}


def test_as_of_takes_the_last_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 7, "c")], "k int, t int, v string")
    assert {(r.k, r.t): r.x for r in S.as_of(left, right, ["k"], "t", "v", "x").collect()} == {(1, 5): "b", (1, 1): None, (2, 9): None}


def test_containment_finds_a_passage_of_very_many_documents(spark):
    items = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "the quick red hen sleeps"), (3, "")], "item_id int, text string")
    texts = ["The quick brown fox jumps", "the quick brown fox", "the quick brown hen", "a quick red hen sleeps here", "none", None]
    docs = spark.range(600 * len(texts)).select(F.col("id").alias("doc_id"), F.array(*map(F.lit, texts))[(F.col("id") % len(texts)).cast("int")].alias("text"))
    got = {(r.item_id, r["rank"]): (r.doc_id, r.token_coverage) for r in C.containment(items, docs, 700).collect()}
    want = {}
    for item, covers in ((1, {0: 1.0, 1: 0.8, 2: 0.6}), (2, {3: 0.8, 2: 0.6})):
        found = sorted((-c, d) for kind, c in covers.items() for d in range(kind, 600 * len(texts), len(texts)))[:700]
        want |= {(item, n): (d, -c) for n, (c, d) in enumerate(found, 1)}
    assert got.keys() == want.keys()
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}

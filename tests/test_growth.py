"""Odd rows that failed on larger tables, and plans and memory that must not grow faster than tables do."""

from __future__ import annotations

import html
import math
import os
import random

import duckdb
from pyspark.sql import functions as F

from scriptorium import catalogue
from scriptorium.functions import text
from scriptorium.operators import chunks as K
from scriptorium.operators import curation as C
from scriptorium.operators import index
from scriptorium.operators import nearest as N
from scriptorium.operators import retrieval as R
from scriptorium.operators import sequences as S


def against_sql(spark, folder, name: str, **tables: str):
    """Rows of a query and of its SQL on tables made by DuckDB queries."""
    con = duckdb.connect()
    for table, made in tables.items():
        path = os.path.join(folder, f"{table}.parquet")
        con.execute(f"COPY ({made}) TO '{path}'")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    want = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = catalogue.queries()[name](spark, str(folder)).select(*columns)
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    return key(got.collect()), key(want.fetchall())


PAGES = "SELECT i AS page_id, 'u' || i AS url, h AS html FROM (VALUES (0, 'x &a'), (1, 'a &amp'), (2, '&amp;lt; &nbsp;&copy; &eacute;'), (3, '&b &'), (4, '<p> </p>'), (5, 'a' || chr(160) || chr(11) || ' b'), (6, '&x<b>y</b>')) t(i, h)"


def test_an_entity_of_one_letter_is_text(spark):
    rows = [("x &a",), ("&a &b",), ("&",), ("&amp",), ("&;",)]
    got = spark.createDataFrame(rows, "t string").select("t", text.unescape(F.col("t")).alias("u")).collect()
    assert [r.u for r in got] == [html.unescape(r.t) for r in got]


def test_pages_are_cleaned_as_in_sql(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "strip_html", pages=PAGES)
    assert got == want


def test_pages_of_journals_are_cleaned_as_in_sql(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "chunk_pages", pages=PAGES)
    assert got == want


def test_sections_are_cut_in_the_order_of_lines_whatever_the_keys(spark, tmp_path):
    # keys of a million and more pass the place that a number of the line leaves them
    rows = ", ".join(f"(1, {n}, {6_000_000 - n * 2_000_000}, {n}, {8000.0 * (n + 2)})" for n in (1, 2, 3))
    lines = f"SELECT k::BIGINT AS l_orderkey, n::INTEGER AS l_linenumber, p::BIGINT AS l_partkey, s::BIGINT AS l_suppkey, e::DOUBLE AS l_extendedprice FROM (VALUES {rows}) t(k, n, p, s, e)"
    got, want = against_sql(spark, tmp_path, "cut_sections", lineitem=lines)
    assert got == want


def test_capitals_of_headings_are_one_for_each_character(spark, tmp_path):
    docs = "SELECT (i * 9 + k)::BIGINT AS doc_id, t AS text FROM (VALUES (0, repeat('ß', 60)), (1, repeat('straße ', 12) || chr(10) || 'x'), (2, 'ﬁnale'), (3, 'ŉ Ğ ß ᾀ 12'), (4, ''), (5, 'STRAẞE'), (6, 'ﬁ'), (7, NULL)) t(i, t), range(9) r(k)"
    got, want = against_sql(spark, tmp_path, "heading_kinds", documents=docs)
    assert got == want


def test_rows_of_words_are_counted_in_linear_time(spark, tmp_path):
    parts = "SELECT i AS p_partkey, 'b' || (i % 3) AS p_brand, CASE WHEN i % 7 <> 0 THEN ((i * 31) % 5000)::INTEGER END AS p_size FROM range(3000) t(i) UNION ALL SELECT 9999, 'none', NULL::INTEGER"
    got, want = against_sql(spark, tmp_path, "row_first_gap", part=parts)
    assert got == want
    # 120,000 values; copying the rows at each value took minutes
    many = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(119_999)), lambda i: i.cast("double")).alias("v"))
    rows = many.select(F.transform(S.first_anchored_rows(F.col("v"), 2200.5), F.size).alias("n")).first().n
    assert sum(rows) == 120_000 and rows[:-1] == [2201] * (len(rows) - 1)
    empty = spark.range(1).select(S.greedy_bins(F.array().cast("array<bigint>"), 3, 600).alias("b"), S.first_anchored_rows(F.array().cast("array<double>"), 1.0).alias("r")).first()
    assert empty == ([], [])


def moved(spark, df) -> int:
    """Rows that df's run writes to shuffles."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    df.write.format("noop").mode("overwrite").save()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    now = stages()
    return sum(now.apply(i).shuffleWriteRecords() for i in range(now.size()) if now.apply(i).stageId() not in before)


def test_hard_negatives_move_few_rows(spark):
    parts = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g"), (F.col("id") % 5).cast("int").alias("l"), (F.col("id") % 3).alias("t"))
    got = C.hard_negatives(parts, "k", "g", "l", "t", 2)
    # a row and its two others; it was fifteen of each row
    assert moved(spark, got) < 6 * 20_000
    few = parts.filter("k < 300").toPandas()
    want = set()
    for a in few.itertuples():
        near = sorted((-(10 if a.l == b.l else 5 if a.t == b.t else 3), b.k) for b in few.itertuples() if a.k != b.k and a.g == b.g and abs(a.l - b.l) <= 1)[:2]
        want |= {(min(a.k, k), max(a.k, k), -w) for w, k in near}
    assert {(min(r.k, r.negative), max(r.k, r.negative), r.weight) for r in C.hard_negatives(parts.filter("k < 300"), "k", "g", "l", "t", 2).collect()} == want


def test_a_search_of_a_table_without_an_index_reads_it_and_builds_none(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    rows = [(i, f"red plate {'widget ' * (i % 4)}x{i}", "Red" if i % 3 else None) for i in range(60)] + [(60, None, None), (61, "", "plate")]
    spark.createDataFrame(rows, "id long, a string, b string").write.parquet(path)
    df = spark.read.parquet(path)
    asked = {"terms": ["red", "widget", "x7", "none"], "key": "id", "weights": [10.0, 1.0]}
    scan = index.searchable(df, "id", ["a", "b"])
    assert isinstance(scan, index.TextScan)
    got, few = sorted(scan.search(**asked).collect()), scan.search(**asked, k=5, allowed=df.filter("id > 30")).collect()
    assert isinstance(index.searchable(df, "id", ["a", "b"]), index.TextScan)
    built = index.index_of(df, "id", ["a", "b"])
    assert isinstance(index.searchable(df, "id", ["a", "b"]), index.TextIndex)
    assert got == sorted(built.search(**asked).collect()) and len(got) == 60
    assert few == built.search(**asked, k=5, allowed=df.filter("id > 30")).collect()


def test_an_index_has_more_pieces_for_a_larger_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t.parquet")
    spark.range(4000).select("id", F.concat(F.lit("the x"), (F.col("id") % 50).cast("string")).alias("t")).write.parquet(path)
    df = spark.read.parquet(path)
    monkeypatch.setattr(index, "PIECE", max(1, index.size_of(df) // 7))
    index.build(df, "id", ["t"], str(tmp_path / "i"))
    held = index.opened(spark, str(tmp_path / "i"), ["t"]).postings
    assert held.filter("term = 'the'").count() == 4000
    # the postings of a frequent word lie in several files
    assert held.filter("term = 'the'").select(F.input_file_name()).distinct().count() > 3


def test_nearest_of_many_with_ties_and_odd_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(4)) for _ in range(3)]) for i in range(600)] + [(i, [1.0, 1.0, 1.0]) for i in range(600, 5000)] + [(5000, None), (5001, [1.0]), (5002, [1.0, None, 2.0])]
    vectors = spark.createDataFrame(rows, "v long, e array<float>").repartition(3)
    queries = vectors.filter("v % 25 = 0").select(F.col("v").alias("q"), F.col("e").alias("w"))
    got = {(r.q, r["rank"]): (r.v, r.distance) for r in R.knn_batch(vectors, queries, "v", "e", "q", "w", 4).collect()}
    held = dict(rows)
    for q in (v for v in held if v % 25 == 0):
        whole = lambda x: x is not None and len(x) == 3 and None not in x
        far = sorted((round(math.dist(held[q], x), 6) if whole(x) and whole(held[q]) else math.inf, v) for v, x in rows)[:4]
        assert [got[q, n] for n in range(1, 5)] == [(v, None if d == math.inf else d) for d, v in far]


def test_items_meet_documents_without_moving_their_pairs(spark):
    rng = random.Random(6)
    words = lambda n: sorted({f"w{min(int(rng.expovariate(0.2)), 40)}" for _ in range(n)})
    docs, items = [(i, words(20)) for i in range(3000)] + [(3000, None), (3001, [])], [(i, words(12)) for i in range(40)] + [(40, None), (41, ["none"])]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, words array<string>")
    top = R.topk_per_group(N.most_shared(frame(docs, "doc_id").repartition(3), frame(items, "item_id"), 10), ["item_id"], 10, F.desc("shared"), "doc_id")
    assert moved(spark, top) <= 3002 + 3 * 10 * 42
    want = {}
    for i, a in items:
        best = sorted((-len(set(a or ()) & set(b or ())), d) for d, b in docs)[:10]
        want |= {(i, n): (d, -s) for n, (s, d) in enumerate(best, 1) if s}
    assert {(r.item_id, r["rank"]): (r.doc_id, r.shared) for r in top.collect()} == want


def test_coverage_meets_classes_of_copies_and_not_their_rows(spark, tmp_path):
    # 2000 copies of a few texts; all pairs of rows would be millions
    one = lambda i: f"SELECT (k * {i} + {i - 1})::BIGINT AS p_partkey, 'red plate' AS p_name, 'B' AS p_brand, CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'tin' ELSE 'Tin' END AS p_type, (k % 4)::INTEGER AS p_size FROM range(1000) t(k)"
    parts = f"SELECT * FROM ({one(1)}) UNION ALL SELECT p_partkey + 100000, * EXCLUDE (p_partkey) FROM ({one(2)}) UNION ALL SELECT 900000 + i, 'plate red ' || (i % 5), 'B', 'tin', (i % 2)::INTEGER FROM range(40) u(i)"
    con = duckdb.connect()
    con.execute(f"COPY ({parts}) TO '{tmp_path}/part.parquet'")
    assert moved(spark, catalogue.queries()["coverage_candidates"](spark, str(tmp_path))) < 60_000
    got, want = against_sql(spark, tmp_path, "coverage_candidates", part=f"SELECT * FROM ({parts}) WHERE p_partkey % 9 < 2")
    assert got == want


def test_entries_are_read_from_json_once(spark):
    parts = spark.range(50).select(F.lit("p").alias("pack"), F.col("id").alias("ordinal"), F.parse_json(F.concat(F.lit('{"_id":"a'), F.col("id"), F.lit('","name":"N'), F.col("id"), F.lit('","type":"feat","system":{"description":{"value":"<p>@UUID[x.Item.a1]</p>"},"rules":[{"key":"GrantItem","uuid":"Compendium.x.Item.a2"}]}}'))).alias("v"))
    names = K.names_of(parts)
    chunks = K.entry_chunks(parts, names)
    # what is joined several times is a table, and no longer made from the JSON each time
    for df in (names, chunks):
        assert "parse_json" not in df._jdf.queryExecution().optimizedPlan().toString().lower().replace("parsejson", "parse_json")
    assert chunks.filter(F.contains("text", F.lit("Grants item: N2")) & F.contains("text", F.lit("Description:\nN1"))).count() == 50


def test_forms_of_texts_are_made_once(spark, tmp_path):
    docs = "SELECT i AS doc_id, 'Source: a' || i % 3 || ' b 2d6 + 1, 3rd c ' || repeat('d e ', i % 5) AS text FROM range(30) t(i)"
    got, want = against_sql(spark, tmp_path, "text_coverage", documents=docs)
    assert got == want
    plan = catalogue.queries()["text_coverage"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan
    words = [f"w{i % 7}" for i in range(40)]
    got = spark.createDataFrame([(words,), (words[:2],), ([],)], "w array<string>").select(text.trigrams(F.col("w")).alias("t")).collect()
    assert [r.t for r in got] == [list(dict.fromkeys(" ".join(words[i : i + 3]) for i in range(38))), [], []]

"""Registered queries: SQL twins, and the pipeline stage by stage."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from scriptorium.llm import queries
from tests.test_catalogue import rows

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as p
    from scriptorium.llm.frames import materialise, table

    docs = table(spark, DATA, "documents")
    bench = [r.text for r in table(spark, DATA, "benchmark").collect()]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        docs = materialise(stage(spark, docs, DATA), f"test-{name}")
        assert docs.columns == p.COLUMNS
        now = {r.doc_id: r.text for r in docs.collect()}
        assert set(now) <= set(before)
        if name == "decontamination":
            assert not any(b in t for b in bench for t in now.values())
            assert all(any(b[:40] in before[i] for b in bench) for i in set(before) - set(now))
        if name == "secrets":
            assert set(now) == set(before)
        if name == "near_dedup":
            assert len(set(now.values())) == len(now)
        before = now
    pieces = p.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(before)
    assert pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).filter("`sum(length)` <> `max(doc_tokens)`").count() == 0

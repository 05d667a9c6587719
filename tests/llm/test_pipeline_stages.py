"""Stages of the pipeline on odd tables."""

from __future__ import annotations

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def folder(spark, tmp_path):
    """An empty benchmark and no labels."""
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_on_odd_rows_and_empty_tables(spark, folder):
    import corpus_pipeline as p

    rows = [(1, "some words of a text that is clean and long enough"), (1, "some words of a text that is clean and long enough"), (2, None), (3, ""), (None, "no key here at all but some words"), (4, "w " * 30_000), (5, "secret=abcdefgh12 in a text")]
    docs = spark.createDataFrame([(*r, None, "s", 7) for r in rows], COLUMNS)
    for name, stage in p.STAGES[:-1]:
        docs, before = stage(spark, docs, folder), docs
        assert docs.columns == p.COLUMNS
        held = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        want = {"toxicity": 7, "near_dedup": 6, "decontamination": 6, "secrets": 6}[name]
        assert len(held) == want, name
        if name == "secrets":
            assert (5, "[SECRET] in a text") in held
        assert stage(spark, before.limit(0), folder).count() == 0
    pieces = p.STAGES[-1][1](spark, docs, folder)
    assert pieces.groupBy("doc_id").count().count() == 6
    assert p.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_an_idle_worker_holds_no_memory_that_its_tasks_freed(spark):
    import os
    import re

    import pyarrow as pa

    from scriptorium.llm.frames import in_arrow

    if not os.path.exists("/proc/self/smaps_rollup"):
        pytest.skip("reads /proc")

    def hungry(batches):
        import sys

        import numpy as np

        for batch in batches:
            blocks = [np.ones(12_500) for _ in range(3000)]  # 300 MB in blocks that the allocator keeps
            sys.modules["numpy"]._kept = np.ones(12_500)  # and one in use behind them
            del blocks
            yield pa.record_batch([pa.array([os.getpid()] * batch.num_rows, pa.int64())], names=["pid"])

    pids = {r.pid for r in in_arrow(spark.range(1).coalesce(1), hungry, "pid long").collect()}
    assert len(pids) == 1
    with open(f"/proc/{pids.pop()}/smaps_rollup") as f:
        assert int(re.search(r"\nAnonymous:\s+(\d+)", f.read())[1]) < 200_000

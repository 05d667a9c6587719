from __future__ import annotations

import json
import zipfile

import pytest

from scriptorium.operators import sqlapi
from scriptorium.sources import readers, snapshots
from scriptorium.streaming import events


def test_packed_json_passes_over_broken_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/packs/feats.json", json.dumps([{"name": "A", "system": {"level": {"value": 3}}}, {"name": "B", "system": {"level": 2}}]))
        z.writestr("x/packs/bad.json", "{nope")
        z.writestr("x/packs/_folders.json", "[]")
        z.writestr("x/other/no.json", "[]")
    rows = readers.packed_json(spark, str(tmp_path / "a.zip")).select("pack", "error", readers.entry_level().alias("level")).collect()
    assert sorted((r.pack, r.level) for r in rows if r.error is None) == [("feats", 2), ("feats", 3)]
    assert [r.pack for r in rows if r.error] == ["bad"]


def test_json_lines_sets_bad_records_aside(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"q": "a"}\nnot json\n{"q": "b"}\n')
    good, bad = readers.json_lines(spark, str(tmp_path / "t.jsonl"), "q string")
    assert sorted(r.q for r in good.collect()) == ["a", "b"]
    assert [r.line for r in bad.collect()] == ["not json"]


def test_failed_snapshot_leaves_the_current_one(spark, tmp_path):
    root = f"file://{tmp_path}/snap"
    some = {"rows": lambda df: df.count() > 0}
    snapshots.publish(spark.range(3), root, some)
    with pytest.raises(snapshots.SnapshotError):
        snapshots.publish(spark.range(0), root, some)
    assert snapshots.current(spark, root).count() == 3
    snapshots.publish(spark.range(5), root, some)
    assert snapshots.current(spark, root).count() == 5


def test_stream_gives_the_batch_state(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    stream = events.latest_state(events.read_events(spark, path, schema), "user_id", "event_id", "event_type")
    events.run_once(stream, "latest_state", str(tmp_path / "cp"))
    batch = events.latest_state(spark.read.parquet(path), "user_id", "event_id", "event_type")
    assert sorted(spark.table("latest_state").collect()) == sorted(batch.collect())


def test_sql_is_bounded_and_read_only(spark):
    spark.range(200).createOrReplaceTempView("numbers")
    rows, more = sqlapi.query(spark, "SELECT id FROM numbers WHERE id >= :least ORDER BY id", 10, least=5)
    assert [r["id"] for r in rows] == list(range(5, 15)) and more
    for bad in ("DROP VIEW numbers", "CREATE TABLE t AS SELECT 1", "WITH x AS (SELECT 1) INSERT INTO numbers SELECT * FROM x"):
        with pytest.raises(sqlapi.NotReadOnly):
            sqlapi.query(spark, bad)


def test_sql_refuses_code_files_and_unknown_relations(spark):
    spark.range(5).createOrReplaceTempView("numbers")
    for bad in (
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT java_method('java.lang.Math', 'abs', -1)", "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`",
        "SELECT (SELECT reflect('java.lang.System', 'nanoTime')) FROM numbers", "WITH x AS (SELECT input_file_name() AS f FROM numbers) SELECT * FROM x", "SELECT * FROM range(10)", "SELECT * FROM nowhere",
        "SELECT TRANSFORM(id) USING 'cat' FROM numbers",
    ):
        with pytest.raises(sqlapi.NotReadOnly):
            sqlapi.query(spark, bad)
    rows, more = sqlapi.query(spark, "WITH x AS (SELECT id, id % 2 AS odd FROM numbers) SELECT odd, count(*) AS n, sum(id) AS s FROM x WHERE id IN (SELECT id FROM numbers) GROUP BY odd ORDER BY odd")
    assert rows == [{"odd": 0, "n": 3, "s": 6}, {"odd": 1, "n": 2, "s": 4}] and not more


def test_sql_stops_at_its_deadline(spark):
    spark.range(60_000).createOrReplaceTempView("many")
    with pytest.raises(sqlapi.TooLong):
        sqlapi.query(spark, "SELECT count(*) AS n FROM many a JOIN many b ON a.id + b.id > sqrt(a.id * b.id) + 3", seconds=1.0)


def test_a_broken_archive_is_a_row(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("packs/feats.json", json.dumps([{"name": "A"}]))
    (tmp_path / "b.zip").write_bytes(b"no archive")
    rows = readers.packed_json(spark, str(tmp_path / "*.zip")).collect()
    assert sorted((r.pack, r.error is None) for r in rows) == [("b.zip", False), ("feats", True)]

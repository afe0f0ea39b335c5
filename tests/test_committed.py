"""Tables that are changed by commits, and streams that write to several places."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.sources.committed import CommittedTable, Conflict
from lumenfold.streaming import capture, live

SCHEMA = "id long, at int, note string"


@pytest.fixture
def table(spark, tmp_path):
    return CommittedTable(spark, f"file://{tmp_path}/table", spark.createDataFrame([], SCHEMA).schema, "id", 8)


def rows(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


def test_changes(spark, table):
    """Upserts, deletions, retention and truncation against a dict."""
    rng, plain = random.Random(1), {}
    frame = lambda data: spark.createDataFrame(data, SCHEMA)
    assert rows(table) == [] and table.version() == 0
    for turn in range(4):
        new = [(rng.randrange(60), 100 * turn + i, f"n{turn}") for i in range(25)]
        table.upsert(frame(new), "at")
        for r in sorted(new, key=lambda r: r[1]):
            plain[r[0]] = r
        assert rows(table) == sorted(plain.values())
        gone = [rng.randrange(80) for _ in range(6)]
        table.delete(frame([(g, 0, None) for g in gone]))
        for g in gone:
            plain.pop(g, None)
        assert rows(table) == sorted(plain.values())
    table.retain(10, "at")
    assert rows(table) == sorted(sorted(plain.values(), key=lambda r: (r[1], r[0]))[-10:])
    before = table.version()
    table.truncate()
    assert rows(table) == [] and len(rows(table, before)) == 10
    assert table.vacuum() > 5 and rows(table) == []


def test_only_touched_buckets_are_written(spark, table):
    table.upsert(spark.range(200).selectExpr("id", "1 as at", "'a' as note"), "at")
    first = table._manifest(1)
    table.upsert(spark.range(3, 4).selectExpr("id", "2 as at", "'b' as note"), "at")
    second = table._manifest(2)
    assert len(first) == 8 and sum(first[b] != second[b] for b in first) == 1
    assert len(rows(table)) == 200 and (3, 2, "b") in rows(table)


def test_a_crash_before_the_commit_leaves_the_old_table(spark, table, monkeypatch):
    table.upsert(spark.range(20).selectExpr("id", "1 as at", "'a' as note"), "at")
    before = rows(table)

    def crash(self, version, manifest):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(CommittedTable, "_commit", crash)
        with pytest.raises(OSError):
            table.upsert(spark.range(20).selectExpr("id", "2 as at", "'b' as note"), "at")
    assert rows(table) == before and table.version() == 1
    assert table.vacuum() == 1 and rows(table) == before
    table.upsert(spark.range(20).selectExpr("id", "2 as at", "'b' as note"), "at")
    assert {r[2] for r in rows(table)} == {"b"}


def test_of_two_writers_one_commits(spark, table):
    table.upsert(spark.range(5).selectExpr("id", "1 as at", "'a' as note"), "at")
    manifest = table._manifest(1)
    table._commit(2, manifest)
    with pytest.raises(Conflict):
        table._commit(2, {})
    assert len(rows(table)) == 5


def packets(n: int) -> list[tuple]:
    rng = random.Random(2)
    return [(rng.choice("ab"), i, i * 4, 4.0, [rng.uniform(-1, 1) for _ in range(4)], None) for i in range(n)]


def test_fan_out_after_a_replayed_batch(spark, tmp_path):
    """Every sink holds each packet once, also where a batch ran twice, the first time without its commit."""
    data = packets(90)
    for i in range(3):
        spark.createDataFrame(data[30 * i : 30 * i + 30], live.PACKET).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        source = spark.readStream.schema(live.PACKET).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = capture.fan_out(source, f"file://{tmp_path}/out", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(200)
        assert query.exception() is None

    run()
    for name in ("2", ".2.crc"):
        os.remove(tmp_path / "checkpoint" / "commits" / name)
    run()
    whole = spark.createDataFrame(data, live.PACKET)
    kept = capture.captured(spark, f"file://{tmp_path}/out", "recorder")
    assert sorted((r.session_id, r.seq, r.samples) for r in kept.collect()) == sorted((r.session_id, r.seq, r.samples) for r in capture.recorded(whole).collect())
    assert kept.count() == 90 and kept.select("batch").distinct().count() == 3
    counts = capture.captured(spark, f"file://{tmp_path}/out", "trace").groupBy("session_id").agg(F.sum("blocks").alias("blocks"), F.sum("samples").alias("samples"), F.max_by("peak", "seq").alias("peak"))
    want = {r.session_id: (r.blocks, r.samples, r.peak) for r in capture.traced(whole).collect()}
    assert {r.session_id: (r.blocks, r.samples, r.peak) for r in counts.collect()} == want

"""Observation streams: restarts, replays and broken batches; bursts and a store's own files."""

import datetime

import pytest

from spindle.operators.temporal import recorded
from spindle.schema import OBSERVATIONS
from spindle.streaming import watch

ROWS = "node_id long, seen_date string, content_hash string, size long, seq long"


def rows_of(table):
    return sorted(map(tuple, table.read().select("node_id", "seen_date", "content_hash", "size").collect()))


@pytest.fixture
def batches(spark):
    first = [(1, "2026-01-03", "a", 10, 1), (2, "2026-01-31", "b", 20, 2), (1, "2026-02-01", "c", 30, 3)]
    second = [(1, "2026-02-01", "d", 40, 4), (3, "2026-02-02", "e", 50, 5), (2, "2025-12-31", None, None, 6)]
    third = [(1, "2026-01-03", "f", 60, 7)]
    return [spark.createDataFrame(b, ROWS) for b in (first, second, third)]


def test_observations_survive_a_restart_and_a_replay(spark, batches, tmp_path):
    at = f"file://{tmp_path}/seen"
    want = spark.createDataFrame([], OBSERVATIONS)
    for n, b in enumerate(batches):
        watch.ObservationTable(spark, at).merge(b, n)  # an object of its own each time, as after a restart
        want = recorded(want, b)
        assert rows_of(watch.ObservationTable(spark, at)) == sorted(map(tuple, want.select("node_id", "seen_date", "content_hash", "size").collect()))
        watch.ObservationTable(spark, at).merge(b, n)
        assert rows_of(watch.ObservationTable(spark, at)) == sorted(map(tuple, want.select("node_id", "seen_date", "content_hash", "size").collect()))
    assert len(rows_of(watch.ObservationTable(spark, at))) == 5


def test_only_touched_months_are_written(spark, batches, tmp_path):
    table = watch.ObservationTable(spark, f"file://{tmp_path}/seen")
    for n, b in enumerate(batches):
        table.merge(b, n)
    assert {p.name for p in (tmp_path / "seen" / "v2").glob("month=*")} == {"month=2026-01"}
    assert sorted(p.name for p in (tmp_path / "seen").glob("manifest-*")) == ["manifest-1", "manifest-2"]


def test_a_batch_that_broke_off_leaves_nothing(spark, batches, tmp_path):
    at = f"file://{tmp_path}/seen"
    watch.ObservationTable(spark, at).merge(batches[0], 0)
    before = rows_of(watch.ObservationTable(spark, at))
    recorded(watch.ObservationTable(spark, at).read(), batches[1]).write.parquet(f"{at}/v1/month=2026-02")  # rows, but no manifest
    assert rows_of(watch.ObservationTable(spark, at)) == before
    watch.ObservationTable(spark, at).merge(batches[1], 1)
    assert len(rows_of(watch.ObservationTable(spark, at))) == 5


def test_a_stopped_stream_goes_on(spark, tmp_path):
    source, at = tmp_path / "in", f"file://{tmp_path}/seen"
    source.mkdir()

    def run():
        stream = spark.readStream.schema(ROWS).parquet(f"file://{source}")
        watch.watch(stream, watch.ObservationTable(spark, at).merge, f"file://{tmp_path}/checkpoint").awaitTermination()

    for n in range(3):
        spark.createDataFrame([(n, f"2026-0{n + 1}-01", "h", n, n)], ROWS).coalesce(1).write.mode("append").parquet(f"file://{source}")
        run()
        assert len(rows_of(watch.ObservationTable(spark, at))) == n + 1
    run()
    assert [r[0] for r in rows_of(watch.ObservationTable(spark, at))] == [0, 1, 2]


def test_bursts_end_after_the_gap(spark):
    at = lambda s: datetime.datetime(2026, 1, 1, 12, 0, 0) + datetime.timedelta(seconds=s)
    events = spark.createDataFrame([(at(0), "a"), (at(1), "b"), (at(2.4), "a"), (at(10), "c")], "ts timestamp, path string")
    got = watch.bursts(events).orderBy("began").collect()
    assert [(r["events"], r["paths"]) for r in got] == [(3, 2), (1, 1)]


def test_own_files_are_not_relevant(spark):
    paths = ["/s/_CURRENT", "/s/_LOCK", "/s/v12/nodes/p.parquet", "/s/a.db-wal", "/s/.x.crc", "/d/a.md", "/d/v12.md", "/d/current"]
    got = watch.relevant(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert sorted(r["path"] for r in got.collect()) == ["/d/a.md", "/d/current", "/d/v12.md"]

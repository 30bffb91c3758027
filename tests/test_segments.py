"""Log segments as a source: offsets of the log, bounded batches, restarts without lost or repeated records."""

from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from evspark.sources import feeds
from evspark.sources.segments import SegmentReader, read_segments

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)


def land(path, partition, first, count, topic="orders"):
    folder = path / f"{topic}-{partition}"
    folder.mkdir(parents=True, exist_ok=True)
    offsets = list(range(first, first + count))
    rows = {"offset": offsets, "key": [f"k{o}" for o in offsets], "value": [None if o % 7 == 0 else f"v{o}" for o in offsets], "timestamp": [BASE + timedelta(seconds=o) for o in offsets]}
    pq.write_table(pa.table(rows), folder / f"{first:020}.parquet")
    return {(topic, partition, o) for o in offsets}


def run(spark, path, tmp_path, **options):
    stream = read_segments(spark, str(path), **options)
    out = str(tmp_path / "out")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()
    rows = [(r.topic, r.partition, r.offset) for r in spark.read.schema(stream.schema).parquet(out).collect()]
    assert len(rows) == len(set(rows))
    return set(rows), query


def test_a_restart_loses_and_repeats_nothing(spark, tmp_path):
    log = tmp_path / "log"
    want = land(log, 0, 0, 10) | land(log, 0, 10, 5) | land(log, 1, 100, 3)
    got, _ = run(spark, log, tmp_path)
    assert got == want
    want |= land(log, 0, 15, 1) | land(log, 2, 0, 4) | land(log, 1, 103, 6, topic="orders")
    got, _ = run(spark, log, tmp_path)
    assert got == want
    got, _ = run(spark, log, tmp_path)  # nothing new
    assert got == want


def test_batches_are_bounded(spark, tmp_path):
    log = tmp_path / "log"
    want = set()
    for k in range(5):
        want |= land(log, 0, 10 * k, 10)
    got, query = run(spark, log, tmp_path, segments_per_batch=2)
    assert got == want
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [20, 20, 10]


def test_latest_leaves_out_what_was_there(spark, tmp_path):
    log = tmp_path / "log"
    land(log, 0, 0, 10)
    got, _ = run(spark, log, tmp_path, start="latest")
    assert got == set()
    want = land(log, 0, 10, 5) | land(log, 1, 7, 2)
    got, _ = run(spark, log, tmp_path, start="latest")
    assert got == want


def test_records_become_events(spark, tmp_path):
    land(tmp_path / "log", 3, 5, 2)
    stream = read_segments(spark, str(tmp_path / "log"))
    events = feeds.from_kafka(stream)
    query = events.writeStream.format("parquet").option("path", str(tmp_path / "e")).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    rows = spark.read.schema(events.schema).parquet(str(tmp_path / "e")).orderBy("ts").collect()
    assert [(r.family, r.source, r.data) for r in rows] == [("kafka", "orders", "v5"), ("kafka", "orders", "v6")]


def test_offsets_without_files(tmp_path):
    reader = SegmentReader(str(tmp_path / "none"), "earliest", 1)
    assert reader.initialOffset() == {} and reader.latestOffset() == {} and reader.partitions({}, {}) == []
    with pytest.raises(ValueError):
        SegmentReader(str(tmp_path), "middle", 1)

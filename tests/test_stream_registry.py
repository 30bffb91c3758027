"""Streams over a changing registry equal the table forms in any order of batches."""

import pickle
import random

import pytest
from pyspark.sql import functions as F

from evspark.operators import registry
from evspark.streaming.registry import PACKED, _pack, drop_noop_updates_stream, late_rows, route_asof_stream

CHANGES = "sensor_key string, op string, spec string, labels map<string,string>, seconds long, seq long"
EVENTS = "sensor_key string, seconds long, seq long, note string"
FAR = 10**9


def change_rows(seed, n=160):
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "a", "b"]), rng.choice(["ADD", "UPDATE", "UPDATE", "UPDATE", "DELETE"]), rng.choice("xy"), {"k": rng.choice("12"), "z": "0"}, rng.randrange(400), i) for i in range(n)]


def event_rows(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "hot", "a", "b", "none"]), rng.randrange(-20, 420), i, None if i % 7 == 0 else f"n{i}") for i in range(n)]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("seconds") + 1000) + F.expr("interval 500 microseconds")).drop("seconds")


def streamed(spark, df, path, batches):
    """The rows as files, one per batch, and a last one far in the future that brings the watermark past all."""
    for k in range(batches):
        df.where(F.pmod(F.xxhash64("seq"), F.lit(batches)) == k).coalesce(1).write.mode("append").parquet(path)
    last = df.limit(1).withColumn("sensor_key", F.lit("~end")).withColumn("ts", F.timestamp_seconds(F.lit(FAR)))
    last.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def ran(df, tmp_path, name="out"):
    path = str(tmp_path / name)
    run = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
    run.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path).where("sensor_key <> '~end'"), run


def plain(df, *columns):
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


@pytest.mark.parametrize("batches", [1, 3])
def test_noop_filter(spark, tmp_path, batches):
    changes = table(spark, change_rows(batches), CHANGES)
    got, run = ran(drop_noop_updates_stream(streamed(spark, changes, str(tmp_path / "in"), batches), "1 hour"), tmp_path)
    columns = ["sensor_key", "op", "spec", "ts", "seq"]
    assert plain(got, *columns) == plain(registry.drop_noop_updates(changes), *columns)
    assert late_rows(run) == 0


@pytest.mark.parametrize("batches, salts", [(1, 1), (3, 4)])
def test_route_asof(spark, tmp_path, batches, salts):
    changes, events = table(spark, change_rows(5 + batches), CHANGES), table(spark, event_rows(6), EVENTS)
    stream = route_asof_stream(
        streamed(spark, events, str(tmp_path / "events"), batches), streamed(spark, changes, str(tmp_path / "changes"), batches), "1 hour", salts=salts
    )
    got, run = ran(stream, tmp_path)
    want = registry.route_asof(events, registry.registry_intervals(changes))
    columns = ["sensor_key", "seq", "ts", "note", "generation", "valid_from"]
    assert want.count() > 50
    assert plain(got, *columns) == plain(want, *columns)
    assert late_rows(run) == 0


def test_late_rows_are_counted(spark, tmp_path):
    changes = table(spark, [("a", "ADD", "x", None, 0, 0)], CHANGES)
    events = table(spark, [("a", 100, 1, "first"), ("a", 5000, 2, "second")], EVENTS)
    late = table(spark, [("a", 200, 3, "late"), ("a", 4990, 4, "in time")], EVENTS)
    path = str(tmp_path / "events")
    events.coalesce(1).write.parquet(path)
    source = spark.readStream.schema(events.schema).parquet(path)
    other = streamed(spark, changes, str(tmp_path / "changes"), 1)
    stream = route_asof_stream(source, other, "60 seconds", salts=2)
    got, _ = ran(stream, tmp_path)
    assert [r.seq for r in got.collect()] == [1]
    late.coalesce(1).write.mode("append").parquet(path)
    table(spark, [("~end", FAR, 9, "")], EVENTS).coalesce(1).write.mode("append").parquet(path)
    # a stream that has brought nothing since the start holds the watermark back
    table(spark, [("~end", "ADD", "x", None, FAR, 9)], CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "changes"))
    got, run = ran(stream, tmp_path)  # a new run goes on where the first has stopped
    assert sorted(r.seq for r in got.collect()) == [1, 2, 4]
    assert late_rows(run) == 1


def test_state_of_a_deleted_sensor_ends(spark, tmp_path):
    changes = table(spark, [("a", "ADD", "x", None, 0, 0), ("a", "DELETE", "x", None, 10, 1), ("b", "ADD", "x", None, 5, 2)], CHANGES)
    _, run = ran(drop_noop_updates_stream(streamed(spark, changes, str(tmp_path / "in"), 1), "1 minute"), tmp_path)
    held = [op["customMetrics"] for p in run.recentProgress[-1:] for op in p["stateOperators"]]
    state = spark.read.format("statestore").option("path", str(tmp_path / "out-checkpoint")).option("stateVarName", "current").load()
    assert [r["key"]["sensor_key"] for r in state.collect()] == ["b"], held


def test_waiting_rows_are_packed():
    """The state holds entries of many rows: as many entries as rows cost a conversion each, both ways."""
    rows = [(i, "ADD", ("a", {"k": "1"}, None)) for i in range(2 * PACKED + 1)]
    entries = _pack(rows)
    assert len(entries) == 3 and [r for e in entries for r in pickle.loads(e[0])] == rows
    assert _pack([]) == []

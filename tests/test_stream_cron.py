"""Cron as a running source equals the table form, across restarts; labels over batches equal those over all events."""

import pytest
from build import routed, sensor, sensors
from pyspark.sql import functions as F

from evspark.plans import actions
from evspark.sources.cron import cron_ticks
from evspark.streaming.cron import cron_tick_stream
from evspark.streaming.ledger import labels_stream

START, END = "2024-01-30 22:00:00", "2024-02-02 03:30:00"


def schedules(spark):
    rows = [("a", 1, "0 30 * * * *"), ("b", 2, "*/20 59 23 * * *"), ("c", 3, "0 0 0 1 * ?"), ("d", 4, "not a schedule"), ("e", 5, "15 0 3 * * 5")]
    return spark.createDataFrame(rows, "sensor_key string, created_seq long, cron string")


def ticks(df):
    return sorted(repr(tuple(r)) for r in df.select("sensor_key", "seq", "ts", "type", "data").collect())


def test_a_clock_that_goes_on_in_several_runs(spark, tmp_path):
    times = ["2024-01-30 21:00:00", "2024-01-30 23:59:40", "2024-01-30 23:59:40", "2024-01-30 23:00:00", "2024-02-01 12:00:00.5", END]
    clock = None
    for t in times:
        spark.createDataFrame([(t,)], "t string").select(F.col("t").cast("timestamp").alias("ts")).write.mode("append").parquet(str(tmp_path / "clock"))
        clock = clock or spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "clock"))
        cron_tick_stream(clock, schedules(spark), START, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        got = ticks(spark.read.parquet(str(tmp_path / "out/ticks")))
        assert got == ticks(cron_ticks(schedules(spark), START, max(START, t, *[x for x in times[: times.index(t)]])))
    assert len(got) > 50


def test_a_batch_that_runs_again_writes_the_same(spark, tmp_path):
    spark.createDataFrame([(END,)], "t string").select(F.col("t").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "clock"))
    clock = spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "clock"))
    for check in ("first", "second"):  # a new checkpoint counts batches from 0 again, as after a failure before the commit
        cron_tick_stream(clock, schedules(spark), START, str(tmp_path / "out"), str(tmp_path / check)).awaitTermination()
        assert ticks(spark.read.parquet(str(tmp_path / "out/ticks"))) == ticks(cron_ticks(schedules(spark), START, END))


@pytest.mark.parametrize("cuts", [[], [30, 60, 90]])
def test_labels_over_batches(spark, tmp_path, cuts):
    reg = sensors(spark, sensor("a", "cron", {"cron": "x"}), sensor("b", "cron", {"cron": "x"}, 2))
    rows = [("ab"[i % 2], i, {"uuid": f"u{i}" if i % 11 in (0, 1) else "", "generation": 1 + i // 70}) for i in range(120)]
    ev = routed(spark, rows)
    want = actions.merge_labels(actions.plan_actions(ev, reg))
    begin = 0
    for end in [*cuts, 120]:
        ev.where((F.col("seq") >= begin) & (F.col("seq") < end)).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
        labels_stream(stream, reg, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        begin = end
    got = spark.read.parquet(str(tmp_path / "out/labels"))
    shown = lambda df: sorted(repr((r.seq, r.sensor_key, r.generation, sorted(r.labels.items()))) for r in df.collect())
    assert shown(got) == shown(want)

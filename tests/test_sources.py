"""Feeds, envelope defaults, start policies and cron schedules on literal rows."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from evspark.sources import envelope as env
from evspark.sources import feeds
from evspark.sources.cron import cron_ticks, cron_valid

TS = "timestamp'2024-01-01 00:00:01.5'"


def test_absent_fields_are_empty_strings(spark):
    df = spark.sql(f"select 'c' channel, cast(null as string) payload, bigint(1) seq, {TS} ts")
    row = feeds.from_redis(df).first()
    assert (row["type"], row["data"], row["uuid"], row["version"]) == ("", "", "", "")


def test_defaults_fill_only_empty_uuid_and_version(spark):
    df = spark.sql(
        f"select 'f' family, bigint(seq) seq, {TS} ts, '' namespace, 's' source, '' type, version, '' data, uuid"
        " from values (1, '', ''), (2, 'v', 'u') t(seq, version, uuid)"
    )
    first, second = env.envelope_defaults(df).orderBy("seq").collect()
    assert first["version"] == "1704067201500000000" and len(first["uuid"]) == 32
    assert (second["version"], second["uuid"]) == ("v", "u")
    again = env.envelope_defaults(df).orderBy("seq").first()
    assert again["uuid"] == first["uuid"]
    assert len(env.envelope_defaults(df, deterministic=False).first()["uuid"]) == 36


def test_unknown_envelope_field_is_refused(spark):
    with pytest.raises(ValueError):
        env.envelope(spark.range(1), "f", F.col("id"), F.current_timestamp(), colour=F.lit("x"))


def test_kafka_sequence_is_unique_and_uuid_filled(spark):
    df = spark.sql(f"select 't' topic, int(p) partition, bigint(o) offset, encode('v', 'UTF-8') value, {TS} timestamp"
                   " from values (0, 1), (1, 0), (1, 1) r(p, o)")
    rows = feeds.from_kafka(df).collect()
    assert len({r["seq"] for r in rows}) == 3 and len({r["uuid"] for r in rows}) == 3
    assert {(r["type"], r["source"], r["data"], r["namespace"], r["version"]) for r in rows} == {("kafka", "t", "v", "", "")}


def test_start_policies(spark):
    df = spark.sql("select 't' topic, p partition, o offset from values (0, 0), (0, 1), (0, 2), (1, 0) r(p, o)")
    ends = spark.sql("select 't' topic, 0 partition, 2 end_offset")
    assert feeds.kafka_start(df, "earliest").count() == 4
    kept = {(r["partition"], r["offset"]) for r in feeds.kafka_start(df, "latest", ends).collect()}
    assert kept == {(0, 2), (1, 0)}
    for bad in ("newest", ""):
        with pytest.raises(ValueError):
            feeds.kafka_start(df, bad)
    with pytest.raises(ValueError):
        feeds.kafka_start(df, "latest")
    assert {(r["partition"], r["end_offset"]) for r in feeds.partition_end_offsets(df).collect()} == {(0, 3), (1, 1)}


def test_request_header_gives_the_uuid_in_any_case(spark):
    df = spark.sql(f"select map('EVENT-uuid', 'u1') headers, 'b' body, bigint(1) seq, {TS} ts")
    assert feeds.from_http(df).first()["uuid"] == "u1"


def test_payload_is_one_line_of_base64_json_in_field_order(spark):
    df = spark.sql(f"select map('Event-Uuid', 'u1') headers, repeat('x', 200) body, bigint(1) seq, {TS} ts")
    payload = env.event_payload(feeds.from_http(df)).first()["payload"]
    assert "\n" not in payload
    assert list(json.loads(base64.b64decode(payload))) == ["namespace", "source", "type", "version", "data", "uuid"]


def test_only_additions_of_cluster_events(spark):
    df = spark.sql(f"select op, 'n' namespace, 's' source, 't' type, 'v1' api_version, 'm' message, bigint(1) seq, {TS} ts"
                   " from values ('ADD'), ('UPDATE'), ('DELETE') t(op)")
    assert [r["data"] for r in feeds.from_k8s_events(df).collect()] == ["m"]


def test_structured_cloud_event(spark):
    body = '{"specversion":"1.0","source":"s","type":"t","data":"d","time":"2024-01-01T00:00:00Z","id":"7"}'
    df = feeds.cloud_events_from_json(spark.createDataFrame([(body,)], "value string"))
    row = feeds.from_cloud_events(df.selectExpr("*", "bigint(1) seq", "time ts")).first()
    assert (row["source"], row["type"], row["version"], row["data"]) == ("s", "t", "1.0", "d")


VALID = [
    "*/15 * * * * *", "0 0 0 1 * 1", "0 30 8-10 * * MON-fri", "0 0 12 29 2 *", "*/1 * * * * *", "0 0 0 ? JAN,mar ?",
    "0 5/20 1,2,3 */10 jan *", "  0  0 0 1 1 0 ", "0 0 0 * * sat", "59 59 23 31 12 6",
]
INVALID = [
    "", "@every 1s", "* * * * *", "* * * * * * *", "60 * * * * *", "* 60 * * * *", "* * 24 * * *", "* * * 0 * *",
    "* * * 32 * *", "* * * * 13 *", "* * * * * 7", "5-1 * * * * *", "*/0 * * * * *", "1-2-3 * * * * *", "1/2/3 * * * * *",
    "x * * * * *", "-1 * * * * *", "* * * mon * *", "1- * * * * *",
]


def test_cron_validity(spark):
    df = spark.createDataFrame([(c,) for c in VALID + INVALID + [None]], "cron string")
    got = {r["cron"]: r["ok"] for r in df.select("cron", cron_valid("cron").alias("ok")).collect()}
    assert [c for c in VALID if not got[c]] == []
    assert [c for c in INVALID if got[c]] == [] and got[None] is False


def ticks(spark, cron, start, end):
    df = spark.createDataFrame([("n/s", 1, cron)], "sensor_key string, created_seq bigint, cron string")
    return sorted(str(r["ts"]) for r in cron_ticks(df, start, end).select(F.col("ts").cast("string").alias("ts")).collect())


def test_cron_every_quarter_minute_is_open_at_the_start(spark):
    got = ticks(spark, "*/15 * * * * *", "2024-01-01 00:00:00", "2024-01-01 00:01:00")
    assert got == ["2024-01-01 00:00:15", "2024-01-01 00:00:30", "2024-01-01 00:00:45", "2024-01-01 00:01:00"]


def test_cron_restricted_days_are_alternatives(spark):
    # 1 Jan 2024 is a Monday
    got = ticks(spark, "0 0 12 3 * 1", "2024-01-01 00:00:00", "2024-01-10 00:00:00")
    assert [g[:10] for g in got] == ["2024-01-01", "2024-01-03", "2024-01-08"]
    assert ticks(spark, "0 0 12 3 * *", "2024-01-01 00:00:00", "2024-01-10 00:00:00") == ["2024-01-03 12:00:00"]
    # a step makes the star a restriction
    stepped = ticks(spark, "0 0 12 */10 * 2", "2024-01-01 00:00:00", "2024-01-12 00:00:00")
    assert [g[:10] for g in stepped] == ["2024-01-01", "2024-01-02", "2024-01-09", "2024-01-11"]


def test_cron_leap_day_and_weekdays(spark):
    assert ticks(spark, "0 0 12 29 2 *", "2023-01-01 00:00:00", "2025-01-01 00:00:00") == ["2024-02-29 12:00:00"]
    got = ticks(spark, "0 30 8-10 * * 1-5", "2024-01-05 00:00:00", "2024-01-08 23:00:00")
    assert [g[:13] for g in got] == ["2024-01-05 08", "2024-01-05 09", "2024-01-05 10", "2024-01-08 08", "2024-01-08 09", "2024-01-08 10"]
    assert ticks(spark, "@every 1s", "2024-01-01 00:00:00", "2024-01-02 00:00:00") == []

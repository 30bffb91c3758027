"""Every registered query against its SQL on the smallest tables, and plan shapes."""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from evspark.workload import fixtures as fx
from evspark.workload import queries as q
from evspark.workload.oracle import ORACLE

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@needs_data
@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query_equals_sql(spark, con, name):
    assert differences(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == ""


def test_every_query_has_sql():
    assert set(q.QUERIES) == set(ORACLE)
    assert set(q.QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).columns == ["sensor_key", "generation", "fire_ts_us", "first_in_gap"]


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_scans_read_needed_columns_and_push_filters(spark):
    plan = physical(q.q_registry_current(spark, SF))
    assert "props" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,props:string>" in plan
    ends = physical(q.q_kafka_end_offsets(spark, SF))
    assert "o_totalprice" not in ends and "o_custkey" not in ends


@needs_data
def test_no_cross_joins_and_no_python_in_batch_plans(spark):
    for name in ("route_mqtt", "route_http_header", "resolve_endpoint", "action_ledger", "idle_firings", "cron_ticks"):
        plan = physical(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "Python" not in plan, name


@needs_data
def test_same_rows_without_broadcast_joins(spark, con):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for name in ("route_mqtt", "route_http_header", "idle_firings", "action_ledger", "resolve_endpoint"):
            df = entry.queries()[name](spark, SF)
            assert "BroadcastHashJoin" not in physical(df), name
            assert differences(df, con, entry.oracle_sql()[name]) == "", name
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@needs_data
@pytest.mark.parametrize("width", [600, 10**9])
def test_same_rows_with_other_slices(spark, con, monkeypatch, width):
    """Slices of ten minutes, and one slice for all time."""
    from evspark.functions import ordered

    original = ordered._slice
    monkeypatch.setattr(ordered, "_slice", lambda df, column, _: original(df, column, width))
    for name in ("registry_noop_filter", "registry_intervals", "route_asof", "running_count", "merge_labels", "resolve_endpoint"):
        assert differences(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == "", name


@needs_data
def test_every_family_is_planned(spark):
    families = {r["family"] for r in q.q_action_ledger(spark, "/root/testdata/sf0.01").select("family").distinct().collect()}
    assert families == {"kafka", "mqtt", "redis", "http", "k8s_events", "cloud_events", "cron"}


@needs_data
def test_work_goes_to_the_shared_folder(spark):
    from evspark.session import as_table, work_dir

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        assert work_dir(spark).startswith(base)
    kept = as_table(fx.resources(spark, SF))
    assert kept.inputFiles() and kept.count() == fx.resources(spark, SF).count()


@needs_data
def test_feeds_meet_their_sensors_at_any_size(spark):
    """Each ten days of the sensors' lifetime hold the same share of a feed, however large its table."""
    from evspark.sources import feeds

    kinds = {"kafka": (feeds.from_kafka, fx.kafka_rows), "mqtt": (feeds.from_mqtt, fx.mqtt_rows), "redis": (feeds.from_redis, fx.redis_rows)}
    for name, (adapt, rows) in kinds.items():
        for sf in ("0.01", "0.1"):
            days = adapt(rows(spark, f"/root/testdata/sf{sf}")).selectExpr("datediff(ts, date'2024-01-01') div 10 part").groupBy("part").count().collect()
            total = sum(r["count"] for r in days)
            assert sorted(r["part"] for r in days) == [0, 1, 2, 3], (name, sf)
            assert all(abs(r["count"] / total - 0.25) < 0.08 for r in days), (name, sf)

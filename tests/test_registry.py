"""Registry feed, options, validation, status, manifests."""

import datetime as dt

import pytest
from build import manifest, sensor, sensors
from pyspark.sql import functions as F

from evspark.functions.columns import fingerprint, maps_equal, overlay, plural, sorted_entries, strict_int
from evspark.operators import meta, registry, status, validate
from evspark.operators.manifest import decode_manifest, gvr


def changes(spark, rows):
    df = spark.createDataFrame([(k, op, spec, i) for i, (k, op, spec) in enumerate(rows)], "sensor_key string, op string, spec string, seq bigint")
    return df.selectExpr("*", "timestamp'2024-01-01' + make_dt_interval(0, 0, int(seq)) ts")


FEED = [("a", "ADD", "1"), ("a", "UPDATE", "1"), ("a", "UPDATE", "2"), ("a", "DELETE", "2"), ("b", "UPDATE", "1"), ("b", "UPDATE", "1"),
        ("c", "DELETE", "1"), ("a", "DELETE", "2"), ("a", "UPDATE", "2"), ("b", "ADD", "1")]


@pytest.mark.parametrize("width", [10**9, 120])
def test_generations(spark, width):
    feed = changes(spark, FEED)
    kept = {r["seq"] for r in registry.drop_noop_updates(feed, slice_width=width).collect()}
    assert kept == {0, 2, 3, 4, 6, 7, 8, 9}
    spans = registry.registry_intervals(feed, slice_width=width).collect()

    def minute(t):
        return None if t is None else t.minute

    got = sorted((r["sensor_key"], r["generation"], r["spec"], minute(r["valid_from"]), str(minute(r["valid_to"]))) for r in spans)
    assert got == [("a", 1, "1", 0, "2"), ("a", 2, "2", 2, "3"), ("a", 3, "2", 8, "None"), ("b", 1, "1", 4, "9"), ("b", 2, "1", 9, "None")]
    events = spark.sql("select 'f' family, bigint(m) seq, 's' source, 'a' sensor_key, timestamp'2024-01-01' + make_dt_interval(0, 0, m) ts"
                       " from values (0), (1), (2), (3), (5), (8), (20) t(m)")
    spans = registry.registry_intervals(feed)
    got = {r["seq"]: r["generation"] for r in registry.route_asof(events, spans, slice_width=width).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 8: 3, 20: 3}


def test_current_state(spark):
    got = {r["sensor_key"]: r["seq"] for r in registry.registry_current(changes(spark, FEED)).collect()}
    assert got == {"a": 8, "b": 9}


def test_label_selectors(spark):
    df = spark.sql("select key, labels from values ('p', map('a', '1', 'b', '2')), ('q', map('a', '2')), ('r', map('c', '')) t(key, labels)")

    def keys(*req):
        return "".join(sorted(r["key"] for r in df.where(registry.label_matches(F.col("labels"), list(req))).collect()))

    assert keys() == "pqr"
    assert keys(("a", "=", "1")) == "p"
    assert keys(("a", "!=", "1")) == "qr"
    assert keys(("a", "in", ["1", "2"])) == "pq"
    assert keys(("a", "notin", ["2"]), ("c", "!exists")) == "p"
    assert keys(("c", "exists")) == "r"
    with pytest.raises(ValueError):
        registry.label_matches(F.col("labels"), [("a", "~", "1")])


def test_list_and_get(spark):
    reg = sensors(spark, sensor("a", "cron", {"cron": "x"}, labels={"k": "1"}), sensor("b", "cron", {"cron": "x"}))
    assert registry.list_sensors(reg, "ns", [("k", "exists")]).count() == 1
    assert registry.list_sensors(reg, "other").count() == 0
    assert registry.get_sensor(reg, "ns", "b").count() == 1 and registry.get_sensor(reg, "ns", "z").count() == 0


def test_kafka_options(spark):
    reg = sensors(spark, sensor("k", "kafka", {"topic": "topic", "servers": "a,b,c", "offsetResetPolicy": "earliest", "version": "1.0.0"}))
    o = meta.parse_meta(reg).first()["kafka_options"]
    assert (o["servers"], o["offset_reset_policy"], o["topic"], o["version"]) == (["a", "b", "c"], "earliest", "topic", "1.0.0")


def test_mqtt_options(spark):
    reg = sensors(spark, sensor("m", "mqtt", {"uri": "uri", "Topic": "topic", "username": "username", "password": "password"}))
    o = meta.parse_meta(reg).first()["mqtt_options"]
    assert (o["uri"], o["topic"], o["username"], o["password"], o["ping_timeout_second"]) == ("uri", "topic", "username", "password", 1)


def test_redis_options(spark):
    base = {"addr": "127.0.0.1:6379", "username": "default", "password": "password", "channel": "test"}
    reg = sensors(spark, sensor("r", "redis", base | {"db": "0"}, 1), sensor("s", "redis", base, 2), sensor("t", "redis", base | {"db": " 1"}, 3))
    o = [r["redis_options"] for r in meta.parse_meta(reg).orderBy("created_seq").collect()]
    assert [x["db"] for x in o] == [0, 0, None] and o[0]["addr"] == "127.0.0.1:6379" and o[0]["channel"] == "test"


def test_exact_option_name_wins(spark):
    reg = sensors(spark, sensor("c", "cron", {"CRON": "upper", "cron": "exact"}))
    assert meta.parse_meta(reg).first()["cron_options"]["cron"] == "exact"


def test_http_target_headers(spark):
    reg = sensors(spark, sensor("c", "cron", {"cron": "x"}, target=("http", {"url": "u", "headers": "a=1,b=x=y,a=2"})))
    t = meta.parse_meta(reg).first()["http_target"]
    assert t["url"] == "u" and t["headers"] == {"a": "2", "b": "x=y"}


MQTT = {"uri": "u", "username": "n", "password": "p"}
CRON = {"cron": "0 0 0 1 1 *"}
CASES = [
    ("trigger.meta_missing", sensor("s", "mqtt", {})),
    ("trigger.meta_missing", sensor("s", "http", {})),
    ("trigger.type_not_supported", sensor("s", "http", {"hosts": "h"})),
    ("trigger.type_not_supported", sensor("s", "MQTT", MQTT)),
    (None, sensor("s", "mqtt", MQTT)),
    ("mqtt.credentials_missing", sensor("s", "mqtt", MQTT | {"password": ""})),
    ("mqtt.credentials_missing", sensor("s", "mqtt", {"uri": "u"})),
    ("mqtt.ping_timeout_not_a_number", sensor("s", "mqtt", {"pingTimeoutSecond": "3"})),
    (None, sensor("s", "cron", CRON)),
    ("cron.missing", sensor("s", "cron", {"cron": ""})),
    ("cron.missing", sensor("s", "cron", {"other": "x"})),
    ("cron.not_valid", sensor("s", "cron", {"cron": "* * * * *"})),
    (None, sensor("s", "redis", {"channel": "c"})),
    (None, sensor("s", "redis", {"db": "-2"})),
    ("redis.db_not_a_number", sensor("s", "redis", {"db": "1.5"})),
    (None, sensor("s", "kafka", {"version": "0.10.1.0", "offsetResetPolicy": "latest"})),
    ("kafka.offset_policy_unknown", sensor("s", "kafka", {"offsetResetPolicy": "", "version": "z"})),
    ("kafka.version_not_valid", sensor("s", "kafka", {"version": "1.0"})),
    ("kafka.version_not_valid", sensor("s", "kafka", {"version": "0.10.1"})),
    ("kafka.allow_idle_not_a_boolean", sensor("s", "kafka", {"allowidleconsumers": "true"})),
    (None, sensor("s", "k8s_http", {"hosts": "h"})),
    (None, sensor("s", "k8s_http", {"hosts": "h"}, operation="scale", body=manifest("Pod"))),
    ("http.operation_not_supported", sensor("s", "k8s_http", {"hosts": "h"}, operation="delete")),
    ("http.kind_not_supported", sensor("s", "k8s_http", {"hosts": "h"}, body=manifest("Job"))),
    ("http.manifest_not_valid", sensor("s", "k8s_http", {"hosts": "h"}, body="{oops")),
    ("http.selector_missing", sensor("s", "k8s_http", {"hosts": "h"}, body='{"kind":"Deployment","metadata":{"name":"x"}}')),
    ("http.resource_missing", sensor("s", "k8s_http", {"hosts": "h"}, has_template=False)),
    ("http.resource_missing", sensor("s", "k8s_http", {"hosts": "h"}, has_k8s=False)),
    ("actor.template_missing", sensor("s", "cron", CRON, has_template=False)),
    ("actor.source_missing", sensor("s", "cron", CRON, body="")),
    ("actor.manifest_not_valid", sensor("s", "cron", CRON, body="[1]")),
    ("actor.http_not_supported", sensor("s", "cron", CRON, has_k8s=False, has_http=True)),
    ("actor.template_empty", sensor("s", "cron", CRON, has_k8s=False)),
    ("target.type_not_supported", sensor("s", "cron", CRON, target=("mqtt", {"topic": "t"}))),
    (None, sensor("s", "cron", CRON, target=("sms", {}))),
    (None, sensor("s", "cron", CRON, target=("http", {"url": "u"}))),
]


def test_validation_reports_the_first_error(spark):
    rows = [r[:-1] + (i,) for i, (_, r) in enumerate(CASES)]
    got = [r["error"] for r in validate.validate_sensors(sensors(spark, *rows)).orderBy("created_seq").collect()]
    assert got == [want for want, _ in CASES]


def test_reconcile(spark):
    gone = dt.datetime(2024, 1, 1)
    reg = sensors(
        spark,
        sensor("a", "cron", CRON, 1), sensor("b", "cron", CRON, 2, finalizers=["other", "sensor-controller"], status=("Ready", "True", "e", "t")),
        sensor("c", "cron", CRON, 3, finalizers=["sensor-controller", "other"], gone=gone), sensor("d", "cron", CRON, 4, status=("Ready", "True", "", "t")),
    )
    a, b, c, d = status.reconcile(reg).orderBy("created_seq").collect()
    assert a["finalizers"] == ["sensor-controller"] and len(a["status"]["eventId"]) == 32
    assert b["finalizers"] == ["other", "sensor-controller"] and b["status"]["eventId"] == "e"
    assert c["finalizers"] == ["other"] and c["status"] is None
    assert d["status"]["eventId"] != "" and d["status"]["triggerId"] == "t"
    ready = [r["r"] for r in reg.orderBy("created_seq").select(status.is_ready().alias("r")).collect()]
    assert ready == [False, True, False, False]


def test_manifest(spark):
    df = spark.createDataFrame([(manifest("Job", "n", "j", 0, {"a": "1"}, containers=["x"]),), ('{"kind":"Pod"}',), ("nope",), ("[]",), (None,)], "manifest string")
    job, pod, *bad = [r["obj"] for r in decode_manifest(df).collect()]
    assert (job["kind"], job["namespace"], job["name"], job["replicas"], job["labels"], job["containers"]) == ("Job", "n", "j", 0, {"a": "1"}, ["x"])
    assert (pod["api_version"], pod["namespace"], pod["replicas"], pod["containers"]) == ("", "", None, [])
    assert bad == [None, None, None]


def test_group_version_resource(spark):
    kinds = {"Deployment": "deployments", "Ingress": "ingresses", "Policy": "policies", "Gateway": "gateways", "Box": "boxes",
             "Shelf": "shelves", "Safe": "saves", "Batch": "batches", "Mesh": "meshes", "Path": "paths", "A": "a", "Quiz": "quizes"}
    df = spark.createDataFrame([(k,) for k in kinds], "kind string")
    assert {r["kind"]: r["p"] for r in df.select("kind", plural(F.col("kind")).alias("p")).collect()} == kinds
    versions = spark.createDataFrame([("apps/v1",), ("v1",), ("a/b/c",), ("",)], "v string").select(gvr(F.col("v"), F.lit("Pod")).alias("g"))
    assert [(r["g"]["group"], r["g"]["version"]) for r in versions.collect()] == [("apps", "v1"), ("", "v1"), ("", ""), ("", "")]


def test_map_functions(spark):
    row = spark.sql(
        "select map('a', '1', 'b', '2') x, map('b', '2', 'a', '1') y, map('a', '1', 'b', '3') z, cast(null as map<string,string>) n"
    ).select(
        maps_equal(F.col("x"), F.col("y")), maps_equal(F.col("x"), F.col("z")), maps_equal(F.col("n"), F.col("n")), maps_equal(F.col("x"), F.col("n")),
        overlay(F.col("x"), F.col("z")),
    ).first()
    assert tuple(row) == (True, False, True, False, {"a": "1", "b": "3"})


def test_strict_integers(spark):
    df = spark.createDataFrame([(v,) for v in ("5", "+5", "-5", " 5", "5.0", "", "99999999999999999999")], "v string")
    assert [r[0] for r in df.select(strict_int(F.col("v"))).collect()] == [5, 5, -5, None, None, None, None]


def test_roster(spark):
    spans = spark.sql("select k sensor_key, timestamp'2024-01-01' + make_dt_interval(0, 0, 0, a) valid_from, timestamp'2024-01-01' + make_dt_interval(0, 0, 0, b) valid_to"
                      " from values ('x', 0.0, 20.0), ('y', 5.0, 20.5), ('z', 30.0, null) t(k, a, b)")
    got = [r["active"] for r in registry.active_roster(spans, "2024-01-01 00:00:00", "2024-01-01 00:00:40").orderBy("ts").collect()]
    assert got == [1, 2, 1, 1, 1]
    keys = registry.active_roster_keys(spans, "2024-01-01 00:00:00", "2024-01-01 00:00:40").collect()
    assert sorted((r["ts"].second, r["sensor_key"]) for r in keys) == [(0, "x"), (10, "x"), (10, "y"), (20, "y"), (30, "z"), (40, "z")]


def test_map_order_is_no_change(spark):
    rows = [("a", "ADD", {"x": "1", "y": "2"}), ("a", "UPDATE", {"y": "2", "x": "1"}), ("a", "UPDATE", {"x": "1"})]
    df = spark.createDataFrame([(k, op, labels, i) for i, (k, op, labels) in enumerate(rows)], "sensor_key string, op string, labels map<string,string>, seq bigint")
    feed = df.selectExpr("*", "timestamp'2024-01-01' + make_dt_interval(0, 0, int(seq)) ts")
    kept = registry.drop_noop_updates(feed, spec=fingerprint(sorted_entries(F.col("labels"))))
    assert sorted(r["seq"] for r in kept.collect()) == [0, 2]


def test_whole_objects_are_compared(spark):
    """Labels in another order are no change; a change of labels alone is one."""
    rows = [("ADD", {"a": "1", "b": "2"}, 0), ("UPDATE", {"b": "2", "a": "1"}, 1), ("UPDATE", {"a": "1", "b": "3"}, 2), ("UPDATE", None, 3), ("UPDATE", {}, 4)]
    df = spark.createDataFrame([("k", op, "s", labels, (labels or {},), i) for op, labels, i in rows], "sensor_key string, op string, spec string, labels map<string,string>, actor struct<meta:map<string,string>>, seq bigint")
    feed = df.selectExpr("*", "timestamp'2024-01-01' + make_dt_interval(0, 0, int(seq)) ts")
    assert sorted(r["seq"] for r in registry.drop_noop_updates(feed).collect()) == [0, 2, 3, 4]

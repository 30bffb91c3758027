"""Driver tables seen as feeds, sensors, changes, pods and resources (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evspark.settings import DEFAULTS

ROSTER_START, ROSTER_END = "2024-01-01 00:00:00", "2024-02-20 00:00:00"
HORIZON = "2024-02-20 00:00:00"
CRON_START, CRON_END = "2024-01-01 00:00:00", "2024-03-01 00:00:00"
EVENT_TYPES = ["signup", "click", "view", "purchase", "error"]


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Driver table; its schema is read from the file once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def k8s_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        "if(event_id % 10 < 9, 'ADD', 'UPDATE') op",
        "'' kind",
        "concat('v', event_id % 3) api_version",
        "event_type type",
        "concat('ns-', user_id % 10) namespace",
        "concat('user-', user_id) source",
        "props message",
        "ts",
        "event_id seq",
        "user_id",
    )


def cloud_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        "concat('user-', user_id % 20) source",
        "event_type type",
        "if(event_id % 7 = 0, '0.3', '1.0') specversion",
        "props data",
        "ts",
        "event_id seq",
    )


def http_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(
        "regexp_extract(url, '^https?://([^/:?#]+)', 1) host",
        "element_at(array('GET', 'POST', 'PATCH'), int(page_id % 3) + 1) method",
        "if(page_id % 11 = 0, '/other', '/') path",
        "map_concat(map('X-Lang', string(page_id % 4)),"
        f" if(page_id % 5 = 0, map('{DEFAULTS.uuid_header.upper()}', concat('req-', page_id)), map())) headers",
        "html body",
        "timestamp_micros((1704067200 + page_id * 7919 % 2419200) * 1000000) ts",
        "page_id seq",
    )


def kafka_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records; offsets grow with the order key within a partition."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('orders-', o_orderstatus) topic",
        "int(o_orderkey % 4) partition",
        "o_orderkey div 4 offset",
        "string(o_orderkey) key",
        "concat(o_custkey, ':', o_orderpriority) value",
        # spread over forty days, so that they meet running sensors, whatever the size of the table; so are MQTT and Redis
        "timestamp_micros((1704067200 + o_orderkey * 7919 % 3456000) * 1000000) timestamp",
    )


def mqtt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "concat('conv/', conv_id % 20, '/', role) topic",
        "text payload",
        "timestamp_micros((1704067200 + (conv_id * 100 + turn) * 7919 % 3456000) * 1000000) ts",
        "conv_id * 100 + turn seq",
    )


def redis_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "source channel", "text payload", "timestamp_micros((1704067200 + doc_id * 1234577 % 3456000) * 1000000) ts", "doc_id seq"
    )


def sensor_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        "concat('ns-', user_id % 10, '/s-', user_id) sensor_key",
        "case event_type when 'signup' then 'ADD' when 'error' then 'DELETE' else 'UPDATE' end op",
        # few distinct specs, so that consecutive equal ones occur
        "concat('spec-', cast(regexp_extract(props, '([0-9]+)', 1) as int) % 2) spec",
        # labels in changing order, and changes of labels alone
        "if(event_id % 2 = 0, map('idle', string(event_id div 8 % 2), 'app', concat('a', user_id % 5)),"
        " map('app', concat('a', user_id % 5), 'idle', string(event_id div 8 % 2))) labels",
        "ts",
        "event_id seq",
    )


def keyed_probe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster events half an hour later, addressed to the sensors of :func:`sensor_changes`."""
    return k8s_event_rows(spark, sf_dir).where("op = 'ADD'").selectExpr(
        "'k8s_events' family", "seq", "ts + interval 30 minutes ts", "source",
        "concat('ns-', user_id % 10, '/s-', user_id) sensor_key",
    )


def pod_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        "concat('p-', user_id) pod",
        "concat('ns-', user_id % 10) namespace",
        "map('app', concat('a', user_id % 5), 'tier', concat('t', user_id % 2), 'user', concat('u', user_id)) labels",
        "case event_type when 'signup' then array() else array(event_type <> 'error') end container_statuses",
        "array(named_struct('name', 'main', 'ports', array("
        " named_struct('name', 'web', 'port', int(8000 + user_id % 3)),"
        " named_struct('name', if(user_id % 4 = 0, 'http', 'admin'), 'port', 9000)))) containers",
        "if(user_id % 50 = 49, '', concat('10.0.0.', user_id % 250)) pod_ip",
        "if(event_id % 17 = 0, 'DELETE', 'UPDATE') op",
        "ts",
        "event_id seq",
    )


def endpoint_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request seven minutes after each event, for the pods of one user or of a namespace."""
    return _events(spark, sf_dir).selectExpr(
        "event_id seq", "ts + interval 7 minutes ts", "concat('ns-', user_id % 10) namespace",
        "if(event_id % 3 = 0, map('app', concat('a', user_id % 5)),"
        " map('user', concat('u', user_id), 'app', concat('a', user_id % 5))) selector",
    )


# Manifest JSON: kind in turn, namespace, labels, replicas, containers.
MANIFEST = """
concat('{"apiVersion":"', element_at(array('apps/v1','apps/v1','v1','batch/v1','policy/v1'), kind_no + 1),
       '","kind":"', element_at(array('Deployment','StatefulSet','Pod','Job','Policy'), kind_no + 1),
       '","metadata":{"name":"obj-', x, '"',
       if(x % 4 = 0, '', concat(',"namespace":"ns-', x % 10, '"')),
       ',"labels":{"app":"a', x % 5, '","tier":"t', x % 2, '"}},"spec":{',
       if(x % 4 = 3, '', concat('"replicas":', x % 4, ',')),
       '"selector":{"matchLabels":{"app":"a', x % 5, '"}}',
       case kind_no when 2 then ',"containers":[{"name":"main"},{"name":"side"}]'
                    when 3 then ',"template":{"spec":{"containers":[{"name":"job"}]}}' else '' end,
       '}}')
"""


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "supplier").selectExpr("s_suppkey x", "int((s_suppkey div 14 + s_suppkey div 280) % 5) kind_no")
    return base.selectExpr("x", "kind_no", f"{MANIFEST} manifest")


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live objects; some lie in a namespace where no plan looks, so they count as absent."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "element_at(array('Deployment','StatefulSet','Pod','Job','Policy'), int((s_suppkey div 14 + s_suppkey div 280) % 5) + 1) kind",
        "if(s_suppkey % 10 in (3, 6, 7), 'elsewhere', concat('ns-', s_suppkey % 10)) namespace",
        "concat('obj-', s_suppkey) name",
        "int(s_suppkey % 3) replicas",
    )


def _map(pairs: dict[str, str]) -> str:
    """SQL of a map without its null entries."""
    items = ", ".join(f"'{k}', {e}" for k, e in pairs.items())
    return f"map_filter(map({items}), (k, v) -> v is not null)"


TRIGGERS = ["k8s_events", "cloud_events", "k8s_http", "kafka", "redis", "mqtt", "cron"]
_TYPE_BY_J = "element_at(array('signup','click','view','purchase','error'), int(j % 5) + 1)"
META = {
    "k8s_events": {
        "kind": "''", "type": _TYPE_BY_J, "namespace": "concat('ns-', j % 10)",
        "apiVersion": "if(j % 2 = 0, concat('v', j % 3), null)", "APIVersion": "if(j % 2 = 1, concat('v', j % 3), null)",
    },
    "cloud_events": {"source": "concat('user-', j % 20)", "type": _TYPE_BY_J, "version": "if(j % 4 = 3, '0.3', '1.0')"},
    "k8s_http": {"hosts": "concat('h', j, '.example.com,www.h', j, '.example.com')", "headers": "concat('x-lang=', j % 4, ',X-Env=e', j)", "suffix": "'/x'"},
    "kafka": {
        "servers": "'a,b,c'", "topic": "concat('orders-', element_at(array('O','F','P'), int(j % 3) + 1))",
        "offsetResetPolicy": "element_at(array('earliest','latest',null,'newest'), int(j % 4) + 1)",
        "version": "if(j % 5 = 4, '1.x', '1.0.0')", "allowIdleConsumers": "if(j % 6 = 4, 'true', null)",
    },
    "redis": {
        "addr": "'127.0.0.1:6379'", "username": "'default'", "password": "'password'",
        "db": "element_at(array('0','3',null,'x1'), int(j % 4) + 1)", "channel": "concat('src', j % 20)",
    },
    "mqtt": {
        "uri": "'tcp://broker:1883'", "username": "'user'", "password": "if(j % 8 = 5, '', 'password')",
        "topic": "element_at(array(concat('conv/', j % 20, '/user'), concat('conv/+/', if(j % 2 = 0, 'user', 'system')),"
                 " concat('conv/', j % 20, '/#'), 'conv/+/+', '#', 'conv/+/user/#'), int(j % 6) + 1)",
        "pingTimeoutSecond": "if(j % 9 = 4, '5', null)",
    },
    "cron": {
        "cron": "element_at(array("
                "concat(x % 60, ' ', x % 59, ' ', x % 24, ' * * *'), concat('*/15 ', x % 60, ' 3 * * ?'),"
                " concat('0 0 ', x % 24, ' ', x % 28 + 1, ' * 1'), '0 0 0 1 * *', '0 30 8-10 * * MON-fri',"
                " '0 0 12 29 2 *', '@every 1s', '0 5/20 1,2,3 */10 jan *'), int(j % 8) + 1)",
    },
}


def sensors(spark: SparkSession, sf_dir: str, live_hosts: bool = False) -> DataFrame:
    """One sensor per supplier, types in turn, with deliberate mistakes.

    ``live_hosts`` gives HTTP sensors hosts that occur in ``pages``.
    """
    base = manifests(spark, sf_dir).selectExpr("*", "int(x div 14) j", "int(x % 7) type_no")
    if live_hosts:
        hosts = http_requests(spark, sf_dir).select(F.col("seq").alias("x"), "host")
        pair = hosts.unionAll(hosts.select(F.col("x") + 7, "host")).groupBy("x").agg(
            F.array_join(F.array_sort(F.collect_set("host")), ",").alias("live")
        )
        base = base.join(pair, "x", "left")
    meta = dict(META)
    if live_hosts:
        meta["k8s_http"] = meta["k8s_http"] | {"hosts": f"coalesce(live, {meta['k8s_http']['hosts']})"}
    metas = " ".join(f"when type_no = {i} then {_map(meta[name])}" for i, name in enumerate(TRIGGERS))
    names = ", ".join(f"'{t}'" for t in TRIGGERS)
    labels = {
        "app": "concat('a', x % 5)",
        "tier": "concat('t', x % 2)",
        DEFAULTS.idle_enable_label: "if(x % 3 <> 0, if(x % 4 = 0, 'true', 'false'), null)",
        DEFAULTS.idle_time_label: "case x % 50 when 48 then '-5' when 23 then '99999999999999' else element_at(array('','0','3600','86400','abc'), int(x % 5) + 1) end",
    }
    target = {
        "namespace": "concat('ns-', x % 10)", "apiVersion": "'v1'", "kind": "'Event'",
        "type": "'Normal'", "message": "concat('m', x)", "reason": "concat('r', x % 3)",
    }
    row = f"""named_struct(
        'sensor_key', concat('ns-', x % 10, '/sensor-', x), 'namespace', concat('ns-', x % 10), 'name', concat('sensor-', x),
        'labels', {_map(labels)},
        'trigger', named_struct(
            'type', if(x % 29 = 28, 'http', element_at(array({names}), type_no + 1)),
            'meta', case when x % 31 = 30 then cast(map() as map<string,string>) {metas} end),
        'actor', named_struct(
            'operation', element_at(array('create','scale','delete','update',''), int(x % 5) + 1),
            'manifest', case when x % 41 = 40 then null when x % 43 = 42 then '{{broken' else manifest end,
            'has_template', x % 37 <> 36, 'has_k8s', x % 26 < 24, 'has_http', x % 26 = 24),
        'target', named_struct(
            'type', if(x % 13 = 12, 'sms', if(x % 11 = 10, 'http', 'events')),
            'meta', if(x % 3 = 0, cast(map() as map<string,string>), {_map(target)})),
        'status', if(x % 6 = 0, null, named_struct(
            'type', 'Ready', 'status', element_at(array('True','False','Unknown'), int(x % 3) + 1),
            'eventId', if(x % 4 = 0, '', concat('e', x)), 'triggerId', if(x % 5 = 0, '', concat('t', x)))),
        'finalizers', element_at(array(array(), array('other'), array('other', '{DEFAULTS.finalizer}')), int(x % 3) + 1),
        'deletion_ts', if(x % 8 = 7, timestamp'2024-01-15', null),
        'created_seq', x)"""
    # the generator keeps the optimizer from copying these long expressions into later filters
    return base.selectExpr(f"inline(array({row}))")


def intervals(sensor_table: DataFrame) -> DataFrame:
    """Generations: 20 days where checks are hourly or daily, else two; every other sensor has a second one.

    The second begins a day after the first has ended and lasts half as long, so owners of a key take turns.
    """
    x = "created_seq"
    length = f"if({x} % 5 in (2, 3), 20, 2)"
    both = sensor_table.selectExpr(
        "sensor_key", f"{x} % 9 first", f"{length} length", f"explode(if({x} % 2 = 0, array(bigint(1), bigint(2)), array(bigint(1)))) generation"
    )
    begin = "if(generation = 1, first, first + length + 1)"
    return both.selectExpr(
        "sensor_key", "generation",
        f"timestamp'2024-01-01' + make_dt_interval(int({begin})) valid_from",
        f"timestamp'2024-01-01' + make_dt_interval(int({begin} + if(generation = 1, length, length div 2))) valid_to",
    )


def schedules(sensor_table: DataFrame) -> DataFrame:
    return sensor_table.where("trigger.type = 'cron'").selectExpr("sensor_key", "created_seq", "trigger.meta['cron'] cron")

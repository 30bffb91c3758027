"""One query per operator over the driver tables.

Output is flat: times as microseconds, maps as sorted ``k=v`` text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.functions.columns import map_text, maps_equal, micros
from evspark.operators import meta, registry, routing, state, status, validate
from evspark.operators.manifest import decode_manifest, gvr
from evspark.plans import actions, endpoints, targets
from evspark.session import as_table, work_dir
from evspark.sources import envelope as env
from evspark.sources import feeds
from evspark.sources.cron import cron_ticks
from evspark.streaming.cron import cron_tick_stream
from evspark.streaming.endpoints import resolve_endpoint_stream
from evspark.streaming.idle import idle_stream
from evspark.streaming.ledger import labels_stream, ledger_stream
from evspark.streaming.registry import drop_noop_updates_stream, route_asof_stream
from evspark.streaming.sinks import write_ledger
from evspark.workload import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
RUN = ["sensor_key", "generation"]


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def us(name: str, alias: str | None = None) -> Column:
    return micros(F.col(name)).alias(alias or f"{name}_us")


def flat(events: DataFrame, *extra: str) -> DataFrame:
    return events.select("seq", us("ts"), *env.FIELDS, *extra)


# sources


@query
def q_kafka_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return flat(feeds.from_kafka(fx.kafka_rows(spark, sf)))


@query
def q_kafka_end_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.partition_end_offsets(fx.kafka_rows(spark, sf))


@query
def q_kafka_latest_only(spark: SparkSession, sf: str) -> DataFrame:
    """A consumer that subscribed when half of each partition was written."""
    rows = fx.kafka_rows(spark, sf)
    ends = feeds.partition_end_offsets(rows).withColumn("end_offset", F.expr("end_offset div 2"))
    return feeds.kafka_start(rows, "latest", ends).select("topic", "partition", "offset", "key")


@query
def q_mqtt_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return flat(feeds.from_mqtt(fx.mqtt_rows(spark, sf)))


@query
def q_redis_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return flat(feeds.from_redis(fx.redis_rows(spark, sf)))


@query
def q_http_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return flat(feeds.from_http(fx.http_requests(spark, sf)))


@query
def q_event_payload(spark: SparkSession, sf: str) -> DataFrame:
    return env.event_payload(feeds.from_http(fx.http_requests(spark, sf))).select("seq", "payload")


@query
def q_k8s_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return flat(feeds.from_k8s_events(fx.k8s_event_rows(spark, sf)))


@query
def q_cloud_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return flat(feeds.from_cloud_events(fx.cloud_event_rows(spark, sf)))


def all_events(spark: SparkSession, sf: str) -> DataFrame:
    return env.union_events(
        feeds.from_kafka(fx.kafka_rows(spark, sf)),
        feeds.from_mqtt(fx.mqtt_rows(spark, sf)),
        feeds.from_redis(fx.redis_rows(spark, sf)),
        feeds.from_http(fx.http_requests(spark, sf)),
        feeds.from_k8s_events(fx.k8s_event_rows(spark, sf)),
        feeds.from_cloud_events(fx.cloud_event_rows(spark, sf)),
        cron_events(spark, fx.sensors(spark, sf)),
    )


def cron_events(spark: SparkSession, sensors: DataFrame) -> DataFrame:
    return cron_ticks(fx.schedules(sensors), fx.CRON_START, fx.CRON_END)


@query
def q_union_events(spark: SparkSession, sf: str) -> DataFrame:
    return flat(all_events(spark, sf), "family")


@query
def q_envelope_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return flat(env.envelope_defaults(all_events(spark, sf)), "family")


@query
def q_cron_ticks(spark: SparkSession, sf: str) -> DataFrame:
    ticks = cron_events(spark, fx.sensors(spark, sf))
    return ticks.select("sensor_key", "seq", us("ts"), "type", "data")


@query
def q_cron_tick_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same ticks, written while a clock goes on: the events' times in four periods, each a run of its own, and the end."""
    base = work_dir(spark)
    times = fx.k8s_event_rows(spark, sf).select("ts")
    schedules = fx.schedules(fx.sensors(spark, sf))
    ends = [F.lit(d).cast("timestamp") for d in ("1970-01-01", "2024-01-05", "2024-01-06", "2024-01-20", fx.CRON_END)]
    for begin, end in zip(ends[:-1], ends[1:], strict=True):
        passed = times.where((F.col("ts") >= begin) & (F.col("ts") < end))
        (passed.unionByName(times.limit(1).select(end.alias("ts"))) if end is ends[-1] else passed).write.mode("append").parquet(f"{base}/in")
        clock = spark.readStream.schema(times.schema).parquet(f"{base}/in")
        cron_tick_stream(clock, schedules, fx.CRON_START, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    ticks = spark.read.parquet(f"{base}/out/ticks")
    return ticks.select("sensor_key", "seq", us("ts"), "type", "data")


# routing


def k8s_events(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.from_k8s_events(fx.k8s_event_rows(spark, sf), keep=("kind",))


def http_events(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.from_http(fx.http_requests(spark, sf), keep=("host", "method", "path", "headers"))


@query
def q_route_key(spark: SparkSession, sf: str) -> DataFrame:
    k8s = k8s_events(spark, sf).select("family", "seq", routing.route_key("k8s_events").alias("route_key"))
    cloud = feeds.from_cloud_events(fx.cloud_event_rows(spark, sf))
    return k8s.unionByName(cloud.select("family", "seq", routing.route_key("cloud_events").alias("route_key")))


@query
def q_route_k8s(spark: SparkSession, sf: str) -> DataFrame:
    return routing.route_k8s(k8s_events(spark, sf), fx.sensors(spark, sf)).select("seq", "type", "namespace", "sensor_key")


@query
def q_route_cloud(spark: SparkSession, sf: str) -> DataFrame:
    events = feeds.from_cloud_events(fx.cloud_event_rows(spark, sf))
    return routing.route_cloud(events, fx.sensors(spark, sf)).select("seq", "source", "type", "version", "sensor_key")


@query
def q_route_http_host(spark: SparkSession, sf: str) -> DataFrame:
    sensors = fx.sensors(spark, sf, live_hosts=True)
    return routing.route_http_host(http_events(spark, sf), sensors).select("seq", "host", "sensor_key")


@query
def q_route_http_header(spark: SparkSession, sf: str) -> DataFrame:
    sensors = fx.sensors(spark, sf, live_hosts=True)
    return routing.route_http_header(http_events(spark, sf), sensors).select("seq", "host", "uuid", "sensor_key")


@query
def q_route_topic(spark: SparkSession, sf: str) -> DataFrame:
    events = env.union_events(feeds.from_kafka(fx.kafka_rows(spark, sf)), feeds.from_redis(fx.redis_rows(spark, sf)))
    return routing.route_topic(events, fx.sensors(spark, sf)).select("family", "source", "seq", "sensor_key")


@query
def q_route_mqtt(spark: SparkSession, sf: str) -> DataFrame:
    events = feeds.from_mqtt(fx.mqtt_rows(spark, sf))
    return routing.route_mqtt(events, fx.sensors(spark, sf)).select("source", "seq", "sensor_key")


def in_time(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Sensors with hosts that occur, and their generations."""
    sensors = fx.sensors(spark, sf, live_hosts=True)
    return sensors, fx.intervals(sensors)


@query
def q_route_k8s_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Owners at event time: the last to register, until it ends or another registers."""
    return routing.route_k8s_asof(k8s_events(spark, sf), *in_time(spark, sf)).select("seq", us("ts"), *RUN)


@query
def q_route_cloud_asof(spark: SparkSession, sf: str) -> DataFrame:
    events = feeds.from_cloud_events(fx.cloud_event_rows(spark, sf))
    return routing.route_cloud_asof(events, *in_time(spark, sf)).select("seq", us("ts"), *RUN)


@query
def q_route_host_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Owners at request time: the first to register, until it ends."""
    return routing.route_host_asof(http_events(spark, sf), *in_time(spark, sf)).select("seq", "host", us("ts"), *RUN)


@query
def q_route_header_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Two front ends with the same numbering send requests that differ in their body only."""
    events = http_events(spark, sf)
    twin = events.withColumn("data", F.concat(F.lit("twin of "), "uuid"))
    routed = routing.route_header_asof(events.unionByName(twin), *in_time(spark, sf))
    return routed.select("seq", "host", F.col("data").startswith("twin of ").alias("twin"), us("ts"), *RUN)


def all_feeds(spark: SparkSession, sf: str, sensors: DataFrame) -> dict[str, DataFrame]:
    """Every family with what its routing needs."""
    return {
        "k8s": k8s_events(spark, sf),
        "cloud": feeds.from_cloud_events(fx.cloud_event_rows(spark, sf)),
        "http": http_events(spark, sf),
        "topics": env.union_events(feeds.from_kafka(fx.kafka_rows(spark, sf)), feeds.from_redis(fx.redis_rows(spark, sf))),
        "mqtt": feeds.from_mqtt(fx.mqtt_rows(spark, sf)),
        "cron": cron_events(spark, sensors),
    }


@query
def q_unrouted(spark: SparkSession, sf: str) -> DataFrame:
    """Events of all families that reach no valid sensor at their time."""
    sensors = as_table(validate.valid_sensors(fx.sensors(spark, sf, live_hosts=True)))
    traced = routing.trace_all(sensors, fx.intervals(sensors), missed=True, **all_feeds(spark, sf, sensors))
    return traced.where("generation is null").select("family", "source", "seq")


# registry


@query
def q_registry_noop_filter(spark: SparkSession, sf: str) -> DataFrame:
    return registry.drop_noop_updates(fx.sensor_changes(spark, sf)).select("sensor_key", "op", "spec", us("ts"), "seq")


@query
def q_registry_current(spark: SparkSession, sf: str) -> DataFrame:
    return registry.registry_current(fx.sensor_changes(spark, sf)).select("sensor_key", "spec", us("ts"), "seq")


@query
def q_registry_intervals(spark: SparkSession, sf: str) -> DataFrame:
    spans = registry.registry_intervals(fx.sensor_changes(spark, sf))
    return spans.select("sensor_key", "generation", "spec", us("valid_from"), us("valid_to"))


@query
def q_route_asof(spark: SparkSession, sf: str) -> DataFrame:
    spans = registry.registry_intervals(fx.sensor_changes(spark, sf))
    routed = registry.route_asof(fx.keyed_probe_events(spark, sf), spans)
    return routed.select("seq", "sensor_key", "generation", us("ts"), us("valid_from"))


def in_batches(df: DataFrame, count: int = 4, key: str = "sensor_key") -> DataFrame:
    """Stream of the rows of ``df`` in ``count`` batches, each with rows of all times, and one that ends it: a row far in the future."""
    path = work_dir(df.sparkSession)
    df.repartition(count, "seq").write.parquet(path)
    last = df.limit(1).withColumns({key: F.lit(END), "ts": F.lit("2200-01-01").cast("timestamp")})
    last.coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


END = "~end"
WHOLE = "400 days"
"""Lateness in which any order of the driver's events is in time."""


def finished(stream: DataFrame, key: str = "sensor_key") -> DataFrame:
    """All rows of a stream that ends, without the row that ended it."""
    base = work_dir(stream.sparkSession)
    run = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out").where(F.col(key) != END)


@query
def q_noop_filter_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The no-op filter on a stream that brings the changes out of order."""
    kept = drop_noop_updates_stream(in_batches(fx.sensor_changes(spark, sf)), WHOLE)
    return finished(kept).select("sensor_key", "op", "spec", us("ts"), "seq")


@query
def q_route_asof_stream(spark: SparkSession, sf: str) -> DataFrame:
    """As-of routing of a stream of events against a stream of changes, both out of order."""
    events, changes = in_batches(fx.keyed_probe_events(spark, sf)), in_batches(fx.sensor_changes(spark, sf))
    routed = finished(route_asof_stream(events, changes, WHOLE, salts=2))
    return routed.select("seq", "sensor_key", "generation", us("ts"), us("valid_from"))


@query
def q_list_sensors(spark: SparkSession, sf: str) -> DataFrame:
    selector = [("app", "in", ["a1", "a2", "a3"]), ("tier", "!=", "t0"), ("gone", "!exists"), (fx.DEFAULTS.idle_time_label, "exists")]
    return registry.list_sensors(fx.sensors(spark, sf), selector=selector).select("sensor_key", "created_seq")


@query
def q_get_sensor(spark: SparkSession, sf: str) -> DataFrame:
    return registry.get_sensor(fx.sensors(spark, sf), "ns-3", "sensor-3").select("sensor_key", "namespace", "name", "created_seq")


@query
def q_parse_meta(spark: SparkSession, sf: str) -> DataFrame:
    parsed = meta.parse_meta(fx.sensors(spark, sf))
    text = {
        "k8s_events": "concat_ws('|', k8s_events_options.kind, k8s_events_options.type, k8s_events_options.api_version, k8s_events_options.namespace)",
        "cloud_events": "concat_ws('|', cloud_events_options.source, cloud_events_options.type, cloud_events_options.version)",
        "kafka": "concat_ws('|', array_join(kafka_options.servers, ';'), kafka_options.topic, kafka_options.offset_reset_policy, kafka_options.version)",
        "redis": "concat_ws('|', redis_options.addr, redis_options.username, redis_options.channel, coalesce(string(redis_options.db), 'bad'))",
        "mqtt": "concat_ws('|', mqtt_options.uri, mqtt_options.topic, mqtt_options.username, mqtt_options.password, string(mqtt_options.ping_timeout_second))",
        "cron": "cron_options.cron",
        "k8s_http": "concat_ws('|', array_join(k8s_http_options.hosts, ';'), array_join(transform(k8s_http_options.headers, h -> concat(h.name, ':', h.value)), ';'), k8s_http_options.suffix)",
    }
    kind = F.col("trigger.type")
    shown = F.coalesce(*[F.when(kind == k, F.expr(e)) for k, e in text.items()], F.lit(""))
    target = F.expr("concat_ws('|', events_target.namespace, events_target.api_version, events_target.kind, events_target.type, events_target.message, events_target.reason)")
    return parsed.select("sensor_key", kind.alias("type"), shown.alias("options"), target.alias("target"))


@query
def q_validate_sensors(spark: SparkSession, sf: str) -> DataFrame:
    return validate.validate_sensors(fx.sensors(spark, sf)).select("sensor_key", "valid", "error")


@query
def q_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return status.reconcile(fx.sensors(spark, sf)).select(
        "sensor_key", F.array_join("finalizers", ",").alias("finalizers"),
        F.col("status.eventId").alias("event_id"), F.col("status.triggerId").alias("trigger_id"),
    )


@query
def q_is_ready(spark: SparkSession, sf: str) -> DataFrame:
    return fx.sensors(spark, sf).select("sensor_key", status.is_ready().alias("ready"))


@query
def q_decode_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return decode_manifest(fx.manifests(spark, sf)).select(
        F.col("x").alias("id"), "obj.api_version", "obj.kind", "obj.namespace", "obj.name",
        map_text(F.col("obj.labels")).alias("labels"), map_text(F.col("obj.match_labels")).alias("match_labels"),
        "obj.replicas", F.array_join("obj.containers", ",").alias("containers"),
    )


@query
def q_gvr(spark: SparkSession, sf: str) -> DataFrame:
    kinds = fx.table(spark, sf, "supplier").selectExpr(
        "s_suppkey id",
        "element_at(array('Deployment','StatefulSet','Pod','Job','Policy','Ingress','Gateway','Namespace','Box','Shelf','Batch','Safe'), int(s_suppkey % 12) + 1) kind",
        "element_at(array('apps/v1','v1','a/b/c','batch/v1beta1'), int(s_suppkey % 4) + 1) api_version",
    )
    return kinds.select("id", gvr(F.col("api_version"), F.col("kind")).alias("g")).select("id", "g.group", "g.version", "g.resource")


@query
def q_maps_equal(spark: SparkSession, sf: str) -> DataFrame:
    pairs = fx.table(spark, sf, "customer").selectExpr(
        "c_custkey id",
        "map('segment', c_mktsegment, 'nation', string(c_nationkey)) a",
        "if(c_custkey % 5 = 4, null, map('nation', string(if(c_custkey % 3 = 0, c_nationkey, 7)), 'segment', c_mktsegment)) b",
    )
    return pairs.select("id", maps_equal(F.col("a"), F.col("b")).alias("same"))


@query
def q_active_roster(spark: SparkSession, sf: str) -> DataFrame:
    spans = registry.registry_intervals(fx.sensor_changes(spark, sf))
    return registry.active_roster(spans, fx.ROSTER_START, fx.ROSTER_END, step_s=600).select(us("ts"), "active")


@query
def q_active_roster_keys(spark: SparkSession, sf: str) -> DataFrame:
    spans = fx.intervals(fx.sensors(spark, sf))
    return registry.active_roster_keys(spans, fx.ROSTER_START, fx.ROSTER_END, step_s=3600).select(us("ts"), "sensor_key")


# state


def registered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Valid sensors, kept as a table, their generations, and these with idle periods."""
    sensors = as_table(validate.valid_sensors(fx.sensors(spark, sf, live_hosts=True)))
    spans = fx.intervals(sensors)
    return sensors, spans, state.with_idle(spans, sensors)


def routed_runs(
    spark: SparkSession, sf: str, checks: bool = False, facts: bool = False, announced: bool = False, objects: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Valid sensors, their generations, these with idle periods, and the events of all families routed to them.

    The validated registry is kept as a table, as a deployment would, because many steps read it. The routed events are not: a message
    reaches every sensor of its topic, so routing again costs less than writing and reading all pairs. With ``checks`` only what
    idle checks need is paired; with ``facts`` some events have a uuid, and all know the last one and the first event's namespace; with
    ``announced`` messages are paired only with sensors that announce them, and come with what these say; with ``objects`` all come with
    the objects of their sensors.
    """
    sensors, spans, runs = registered(spark, sf)
    only = as_table(targets.event_targets(sensors)) if announced else None
    known = as_table(actions.sensor_objects(sensors)) if objects else only
    given = all_feeds(spark, sf, sensors)
    if facts:
        given = {name: with_some_uuids(events) for name, events in given.items()}
    routed = routing.route_all(sensors, spans, runs if checks else None, facts, only=only, known=known, **given)
    return sensors, spans, runs, routed


def changing_runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Generations of the change feed and the probe events routed to them."""
    spans = registry.registry_intervals(fx.sensor_changes(spark, sf))
    routed = registry.route_asof(fx.keyed_probe_events(spark, sf), spans)
    return spans, routed


@query
def q_sensor_state(spark: SparkSession, sf: str) -> DataFrame:
    spans, routed = changing_runs(spark, sf)
    return state.sensor_state(routed, spans).select(*RUN, "n_events", us("last_ts"))


@query
def q_running_count(spark: SparkSession, sf: str) -> DataFrame:
    spans = registry.registry_intervals(fx.sensor_changes(spark, sf))
    routed = registry.routed_in_order(fx.keyed_probe_events(spark, sf), spans)
    return state.running_count(routed).select(*RUN, "seq", "event_count")


@query
def q_idle_config(spark: SparkSession, sf: str) -> DataFrame:
    return state.idle_config(fx.sensors(spark, sf))


@query
def q_idle_firings(spark: SparkSession, sf: str) -> DataFrame:
    _, _, runs, routed = routed_runs(spark, sf, checks=True)
    return state.idle_firings(routed, runs, fx.HORIZON).select(*RUN, us("fire_ts"), "first_in_gap")


@query
def q_idle_firings_users(spark: SparkSession, sf: str) -> DataFrame:
    """The same check with one sensor per user and a period of six hours."""
    routed = k8s_events(spark, sf).select("ts", F.col("source").alias("sensor_key"), F.lit(1).cast("bigint").alias("generation"))
    runs = routed.select(*RUN).distinct().selectExpr(
        *RUN, "timestamp'2024-01-01' valid_from", "cast(null as timestamp) valid_to", "bigint(21600) idle_s"
    )
    return state.idle_firings(routed, runs, "2024-01-31 00:00:00").select("sensor_key", us("fire_ts"), "first_in_gap")


@query
def q_activity_sessions(spark: SparkSession, sf: str) -> DataFrame:
    routed = k8s_events(spark, sf).select("ts", F.col("source").alias("sensor_key"), F.lit(1).cast("bigint").alias("generation"))
    runs = routed.select(*RUN).distinct().withColumn("idle_s", F.lit(21600).cast("bigint"))
    return state.activity_sessions(routed, runs).select(
        "sensor_key", us("session_start"), us("session_end"), "n_events"
    )


# plans


def unplaced(spark: SparkSession, sf: str, operation: str) -> tuple[DataFrame, DataFrame]:
    """Planned events of the sensors with this operation, with the facts of their generations, and all generations with idle periods."""
    sensors, spans, runs = registered(spark, sf)
    only = as_table(sensors.where(F.col("actor.operation") == operation).select("sensor_key"))
    own = sensors.join(only.distinct(), "sensor_key", "left_semi")
    scaling = operation == "scale"

    def know(few: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        deciding = as_table(actions.plan_actions(few, own).where(F.col("operation") == operation))
        return actions.run_knowledge(deciding, own, fx.resources(spark, sf), runs if scaling else None)

    checked = actions.scaling_runs(runs, sensors) if scaling else None
    routed, _ = routing.route_deciding(sensors, spans, checked, only=only, know=know, **all_feeds(spark, sf, sensors))
    return actions.plan_actions(routed, own), runs


def planned(spark: SparkSession, sf: str) -> DataFrame:
    """Planned events with the namespace of their object, which is known of a generation before its events are paired with it."""
    sensors, spans, _ = registered(spark, sf)
    know = lambda few: actions.namespace_knowledge(as_table(few), sensors)
    routed, _ = routing.route_deciding(sensors, spans, know=know, **all_feeds(spark, sf, sensors))
    return actions.resolve_namespace(actions.plan_actions(routed, sensors))


def with_some_uuids(plan: DataFrame) -> DataFrame:
    return plan.withColumn("uuid", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("u-"), "seq")).otherwise(""))


def planned_with_uuids(spark: SparkSession, sf: str) -> DataFrame:
    sensors, _, _, routed = routed_runs(spark, sf, facts=True, objects=True)
    return actions.resolve_namespace(actions.plan_actions(routed, sensors))


@query
def q_plan_actions(spark: SparkSession, sf: str) -> DataFrame:
    sensors, _, _, routed = routed_runs(spark, sf, objects=True)
    return actions.plan_actions(routed, sensors).select("family", "seq", "sensor_key", "operation", "kind", "resource", "action", "error")


@query
def q_resolve_namespace(spark: SparkSession, sf: str) -> DataFrame:
    return planned(spark, sf).select("family", "seq", *RUN, "resource", "target_namespace")


@query
def q_event_dict(spark: SparkSession, sf: str) -> DataFrame:
    events = with_some_uuids(k8s_events(spark, sf))
    return events.select("seq", map_text(actions.event_dict()).alias("labels"))


@query
def q_merge_labels(spark: SparkSession, sf: str) -> DataFrame:
    merged = actions.merge_labels(planned_with_uuids(spark, sf))
    return merged.select("family", "seq", *RUN, map_text(F.col("labels")).alias("labels"))


def messages_unrouted(spark: SparkSession, sf: str, sensors: DataFrame, spans: DataFrame) -> DataFrame:
    """Events of all families as input of a stream: a message reaches many sensors and is routed in its batch, the others before."""
    given = all_feeds(spark, sf, sensors)
    messages = env.union_events(given.pop("topics"), given.pop("mqtt"))
    return routing.route_all(sensors, spans, **given).unionByName(messages, allowMissingColumns=True)


def routed_or_not(batch: DataFrame) -> dict[str, DataFrame]:
    """A batch of :func:`messages_unrouted`: events that are routed, and the messages of topics and of filters."""
    new = batch.where("generation is null").drop(*RUN)
    return {"done": batch.where("generation is not null"), "topics": new.where("family <> 'mqtt'"), "mqtt": new.where("family = 'mqtt'")}


@query
def q_merge_labels_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The labels of the same events as a stream of four batches that follow one another in time."""
    sensors, spans, _ = registered(spark, sf)
    spans, mixed = as_table(spans), routing.mixed_sensors(sensors, spans)
    routes, objects = routing.shared_routes(sensors, spans, mixed), as_table(actions.sensor_objects(sensors))
    route = lambda batch: routing.route_uuids(sensors, spans, routes, mixed, known=objects, **routed_or_not(batch))
    events = with_some_uuids(messages_unrouted(spark, sf, sensors, spans))
    base, asked = work_dir(spark), ["family", "seq", *RUN, "labels"]
    days = [F.lit(d).cast("timestamp") for d in ("1970-01-01", "2024-01-05", "2024-01-09", "2024-01-16", "2100-01-01")]
    for begin, end in zip(days[:-1], days[1:], strict=True):
        # a period's files, as many as there are, are one batch
        events.where((F.col("ts") >= begin) & (F.col("ts") < end)).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        labels_stream(stream, sensors, f"{base}/out", f"{base}/checkpoint", route=route, columns=asked).awaitTermination()
    merged = spark.read.parquet(f"{base}/out/labels")
    return merged.select("family", "seq", *RUN, map_text(F.col("labels")).alias("labels"))


@query
def q_event_env(spark: SparkSession, sf: str) -> DataFrame:
    env_rows = actions.event_env(with_some_uuids(planned(spark, sf)))
    text = F.array_join(F.transform("env", lambda e: F.concat(e["name"], F.lit("="), e["value"])), ",")
    return env_rows.select("family", "seq", "sensor_key", "container", text.alias("env"))


@query
def q_plan_create(spark: SparkSession, sf: str) -> DataFrame:
    plan = actions.plan_create(planned_with_uuids(spark, sf))
    return plan.select("family", "seq", *RUN, "resource", "target_namespace", "name", "client", map_text(F.col("labels")).alias("labels"), "n_containers")


LEDGER_OUT = ["family", "source", "seq", *RUN, "operation", "resource", "target_namespace", "name", "action", "outcome", "error"]


@query
def q_plan_delete(spark: SparkSession, sf: str) -> DataFrame:
    return actions.plan_delete(unplaced(spark, sf, "delete")[0], fx.resources(spark, sf)).select(*LEDGER_OUT)


@query
def q_plan_scale_up(spark: SparkSession, sf: str) -> DataFrame:
    plan, runs = unplaced(spark, sf, "scale")
    return actions.plan_scale_up(plan, fx.resources(spark, sf), runs).select(*LEDGER_OUT)


def ledger(spark: SparkSession, sf: str, by_time: bool = False) -> DataFrame:
    sensors, spans, runs = registered(spark, sf)
    scaling = actions.scaling_runs(runs, sensors)
    resources = fx.resources(spark, sf)
    know = lambda few: actions.run_knowledge(as_table(actions.plan_actions(few, sensors)), sensors, resources, runs)
    routed, _ = routing.route_deciding(sensors, spans, scaling, by_time, know=know, **all_feeds(spark, sf, sensors))
    return actions.action_ledger(actions.plan_actions(routed, sensors), resources, runs)


@query
def q_action_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return ledger(spark, sf).select(*LEDGER_OUT)


@query
def q_ledger_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger of the same events as a stream of four batches that follow one another in time."""
    sensors, spans, runs = registered(spark, sf)
    scaling, mixed = as_table(actions.scaling_runs(runs, sensors)), routing.mixed_sensors(sensors, spans)
    events = messages_unrouted(spark, sf, sensors, spans)
    route = lambda batch, know: routing.route_deciding(sensors, spans, scaling, mixed=mixed, know=know, **routed_or_not(batch))
    base = work_dir(spark)
    days = [F.lit(d).cast("timestamp") for d in ("1970-01-01", "2024-01-05", "2024-01-09", "2024-01-16", "2100-01-01")]
    resources = fx.resources(spark, sf)
    for begin, end in zip(days[:-1], days[1:], strict=True):
        # a period's files, as many as there are, are one batch
        events.where((F.col("ts") >= begin) & (F.col("ts") < end)).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        ledger_stream(stream, sensors, resources, runs, f"{base}/out", f"{base}/checkpoint", route=route, asks=True).awaitTermination()
    return spark.read.parquet(f"{base}/out/ledger").select(*LEDGER_OUT)


@query
def q_ledger_summary(spark: SparkSession, sf: str) -> DataFrame:
    return actions.ledger_summary(ledger(spark, sf))


@query
def q_plan_scale_zero(spark: SparkSession, sf: str) -> DataFrame:
    sensors, spans, runs = registered(spark, sf)
    # idle checks and first events need few rows, so events are not paired with all their sensors
    few = as_table(routing.route_deciding(sensors, spans, runs, **all_feeds(spark, sf, sensors))[1])
    gaps = state.idle_gaps(few, runs, fx.HORIZON)
    plan = actions.plan_scale_zero(gaps, few, sensors, fx.resources(spark, sf))
    return plan.select(*RUN, us("fire_ts"), "kind", "target_namespace", "name", "action", "outcome", "error")


@query
def q_target_events(spark: SparkSession, sf: str) -> DataFrame:
    sensors, _, _, routed = routed_runs(spark, sf, announced=True)
    rows = targets.target_events(routed, sensors)
    return rows.select("family", "seq", us("ts"), "sensor_key", *[f"target_{f}" for f in targets.EVENT_FIELDS])


@query
def q_write_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger written by day and read back."""
    path = work_dir(spark)
    write_ledger(ledger(spark, sf, by_time=True), path, by_time=True)
    return spark.read.parquet(path).select("family", "seq", *RUN, "action", "outcome", F.col("day").cast("string").alias("day"))


@query
def q_select_pods(spark: SparkSession, sf: str) -> DataFrame:
    pods = fx.pod_snapshots(spark, sf)
    matched = endpoints.select_pods(pods, fx.endpoint_requests(spark, sf))
    labels = pods.select("namespace", F.to_json(endpoints.sorted_entries(F.col("labels"))).alias("labels_key"), "pod").distinct()
    found = matched.join(labels, ["namespace", "labels_key"])
    pairs = "array<struct<key:string,value:string>>"
    shown = F.array_join(F.transform(F.from_json("selector_key", pairs), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return found.select("namespace", shown.alias("selector"), "pod")


@query
def q_ready_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    return endpoints.ready_endpoints(fx.pod_snapshots(spark, sf)).select("seq", "pod", "ready", "endpoint", "no_address")


@query
def q_resolve_endpoint(spark: SparkSession, sf: str) -> DataFrame:
    found = endpoints.resolve_endpoint(fx.endpoint_requests(spark, sf), fx.pod_snapshots(spark, sf))
    return found.select("seq", us("ready_ts"), "pod", "endpoint", "no_address")


@query
def q_resolve_endpoint_patient(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a timeout of two days."""
    found = endpoints.resolve_endpoint(fx.endpoint_requests(spark, sf), fx.pod_snapshots(spark, sf), timeout_s=172800)
    return found.select("seq", us("ready_ts"), "pod", "endpoint", "no_address")


@query
def q_resolve_endpoint_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Waiting requests on streams of requests and pod snapshots, both out of order."""
    requests, pods = (in_batches(f(spark, sf), key="namespace") for f in (fx.endpoint_requests, fx.pod_snapshots))
    found = finished(resolve_endpoint_stream(requests, pods, WHOLE, salts=2), "namespace")
    return found.select("seq", us("ready_ts"), "pod", "endpoint", "no_address")


@query
def q_idle_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Streaming idle detector over the events file, one sensor per user, six-hour period.

    The firings are written to the work folder and read back.
    """
    schema = fx.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    routed = events.selectExpr(
        "concat('user-', user_id) sensor_key", "bigint(1) generation", "cast(ts as timestamp) ts",
        "timestamp'2024-01-01' valid_from", "cast(null as timestamp) valid_to", "bigint(21600) idle_s",
    )
    base = work_dir(spark)
    run = (
        idle_stream(routed).writeStream.format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{base}/out").select(*RUN, us("fire_ts"), "first_in_gap")

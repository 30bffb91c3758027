"""Ledger, labels and targets without storing, ordering or shuffling pairs of events and sensors equal those over all pairs."""

from functools import reduce

from build import manifest, runs, sensor, sensors
from pyspark.sql import functions as F

from evspark.functions.columns import map_text
from evspark.operators import routing, state
from evspark.plans import actions, targets
from evspark.streaming.ledger import labels_stream, ledger_stream
from evspark.streaming.sinks import write_ledger

GENERATIONS = [
    ("k0", 0, 900, 60), ("k1", 31, 700, 45), ("k2", 333, None, 100), ("k3", 64, 128, 1), ("k4", 7, 1800, 600), ("all", 3, 3600, 77), ("one", 0, None, 32),
    ("cron", 0, 900, 60), ("red", 5, 800, 9), ("two", 0, 900, 60), ("none", 0, 90, 60), ("del", 100, 500, 60), ("del2", 90, 400, 60),
]


def registry(spark):
    scale = lambda n: {"operation": "scale", "body": manifest(name=n)}
    gone = {"operation": "delete", "body": manifest(name="k0", namespace="n1")}
    return sensors(
        spark, *[sensor(f"k{i}", "kafka", {"topic": "t"}, i, **scale(f"k{i}")) for i in range(5)], sensor("all", "mqtt", {"topic": "#"}, 7, **scale("all")),
        sensor("one", "mqtt", {"topic": "m/+"}, 8, **scale("one")), sensor("cron", "cron", {"cron": "x"}, 9, **scale("cron")),
        sensor("red", "redis", {"channel": "r"}, 10, **scale("red")), sensor("red", "redis", {"channel": "r"}, 10, **scale("red")),
        sensor("two", "kafka", {"topic": "t"}, 11, **scale("two")), sensor("two", "kafka", {"topic": "u"}, 12, **scale("two")),
        sensor("none", "kafka", {"topic": "v"}, 13), sensor("del", "kafka", {"topic": "t"}, 14, **gone), sensor("del2", "mqtt", {"topic": "#"}, 15, **gone),
    )


def feed(spark, family, sources, n=400):
    """Bursts of events with gaps between them, some without a time, some twice."""
    source = f"element_at(array({', '.join(repr(x) for x in sources)}), int(id % {len(sources)}) + 1)"
    at = f"if(id % 41 = 40, null, timestamp_micros(1704067200000000 + (id * id * 7 % 37 + id div 20 * {83 if family == 'mqtt' else 47}) * 1000000)) ts"
    df = spark.sql(f"select '{family}' family, id seq, {at}, concat('n', id % 5) namespace, {source} source, '' type, '' version, 'd' data, if(id % 9 = 4, concat('u', id), '') uuid from range({n})")
    return df.unionByName(df.where("seq % 10 = 4"))


def given(spark):
    return {
        "topics": feed(spark, "kafka", ["t", "t", "u"]).unionByName(feed(spark, "redis", ["r"])), "mqtt": feed(spark, "mqtt", ["m/a", "m/b", "x"]),
        "cron": feed(spark, "cron", ["c"], 60).withColumn("sensor_key", F.lit("ns/cron")),
    }


def shown(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


LIVE = [("Deployment", "n1", "k0", 1), ("Deployment", "default", "all", 3), ("Deployment", "n0", "k2", 2)]


def live(spark):
    return spark.createDataFrame(LIVE, "kind string, namespace string, name string, replicas int")


def whole(spark, reg, spans):
    return actions.action_ledger(actions.plan_actions(routing.route_all(reg, spans.drop("idle_s"), **given(spark)), reg), live(spark), spans)


def test_few_rows_decide_the_ledger(spark):
    reg, spans = registry(spark), runs(spark, *GENERATIONS)
    routed, few = routing.route_deciding(reg, spans.drop("idle_s"), actions.scaling_runs(spans, reg), True, **given(spark))
    plan, deciding = actions.plan_actions(routed, reg), actions.plan_actions(few, reg)
    got = actions.action_ledger(plan, live(spark), spans, few=deciding)
    want = shown(whole(spark, reg, spans), *actions.LEDGER)
    assert shown(got, *actions.LEDGER) == want and len(want) > 1500
    assert {a for a in ("create", "patch", "delete", "none") if any(f"action='{a}'" in w for w in want)} == {"create", "patch", "delete", "none"}


def test_rows_come_with_what_is_known_before_they_are_made(spark):
    reg, spans = registry(spark), runs(spark, *GENERATIONS)
    plain = spans.drop("idle_s")
    planned = lambda few: actions.plan_actions(few, reg).localCheckpoint()
    know = lambda few: actions.run_knowledge(planned(few), reg, live(spark), spans)
    routed, _ = routing.route_deciding(reg, plain, actions.scaling_runs(spans, reg), know=know, **given(spark))
    got = actions.action_ledger(actions.plan_actions(routed, reg), live(spark), spans)
    assert shown(got, *actions.LEDGER) == shown(whole(spark, reg, spans), *actions.LEDGER)
    # messages meet a route that knows its object and its facts; only what reaches one sensor is looked up
    topics = {"topics": given(spark)["topics"]}
    routed, _ = routing.route_deciding(reg, plain, know=know, **topics)
    plan = actions.action_ledger(actions.plan_actions(routed, reg), live(spark), spans)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # its marks, its route

    place = lambda few: actions.namespace_knowledge(few.localCheckpoint(), reg)
    routed, _ = routing.route_deciding(reg, plain, know=place, **given(spark))
    got = actions.resolve_namespace(actions.plan_actions(routed, reg))
    want = actions.resolve_namespace(actions.plan_actions(routing.route_all(reg, plain, **given(spark)), reg))
    assert shown(got, *actions.ROW, "target_namespace") == shown(want, *actions.ROW, "target_namespace")


def test_plans_of_one_operation_pair_its_sensors_only(spark):
    reg, spans = registry(spark), runs(spark, *GENERATIONS)
    gone = reg.where("actor.operation = 'delete'")
    know = lambda few: actions.run_knowledge(actions.plan_actions(few, gone).localCheckpoint(), gone, live(spark))
    routed, _ = routing.route_deciding(reg, spans.drop("idle_s"), only=gone, know=know, **given(spark))
    got = actions.plan_delete(actions.plan_actions(routed, gone), live(spark))
    every = actions.plan_actions(routing.route_all(reg, spans.drop("idle_s"), **given(spark)), reg)
    want = shown(actions.plan_delete(every, live(spark)), *actions.LEDGER)
    assert shown(got, *actions.LEDGER) == want and any("action='delete'" in w for w in want)
    assert {r["sensor_key"] for r in routed.select("sensor_key").distinct().collect()} == {"ns/del", "ns/del2"}


def test_gaps_and_scaling_to_zero_come_from_few_rows(spark):
    reg, spans = registry(spark), runs(spark, *GENERATIONS)
    plain, until = spans.drop("idle_s"), "2024-01-01 02:00:00"
    _, few = routing.route_deciding(reg, plain, spans, **given(spark))
    every = routing.route_all(reg, plain, **given(spark))
    got, want = (shown(actions.plan_scale_zero(state.idle_gaps(rows, spans, until), rows, reg, live(spark)), "*") for rows in (few, every))
    assert got == want and len(want) > 100


def test_events_meet_routes_of_their_time_only(spark):
    """Each event is compared with routes that hold in its slice of time, not with all of its key."""
    second = "timestamp_micros(1704067200000000 + {} * 1000000L)"
    events = spark.sql(f"select 't' source, id seq, {second.format('id * 7')} ts from range(-20, 2000)").unionByName(spark.sql("select 't' source, 1L seq, cast(null as timestamp) ts"))
    spans = [f"{second.format('id * 60')} valid_from, {second.format('id * 60 + 60 + id % 7 * 50')} valid_to", f"{second.format('id * 600')} valid_from, null valid_to", f"null valid_from, {second.format('id')} valid_to"]
    routes = reduce(lambda a, b: a.unionByName(b), [spark.sql(f"select 't' source, concat({k}, '/', id) sensor_key, id generation, {x} from range({n})") for k, (x, n) in enumerate(zip(spans, (200, 3, 2), strict=True))]).localCheckpoint()
    held = "ts >= valid_from and (valid_to is null or ts < valid_to)"
    want = events.join(routes, "source").where(held)
    got = routing.paired(events, routes, ["source"])
    assert shown(got, *want.columns) == shown(want, *want.columns) and want.where("valid_to is null").count() > 0
    assert "_slice" in got.columns
    for empty in (routes.limit(0), routes.where("valid_from is null")):
        assert routing.paired(events, empty, ["source"]).count() == 0


def test_few_rows_do_not_grow_with_the_events_of_a_topic(spark):
    reg = sensors(spark, *[sensor(f"k{i}", "kafka", {"topic": "t"}, i, operation="scale") for i in range(5)])
    spans = runs(spark, *[(f"k{i}", i, 3000, 600) for i in range(5)])
    events = spark.sql("select 'kafka' family, id seq, timestamp_micros(1704067200000000 + id * 300000) ts, '' namespace, 't' source, '' type, '' version, '' data, '' uuid from range(10000)")
    routed, few = routing.route_deciding(reg, spans.drop("idle_s"), spans, topics=events)
    assert routed.count() > 49_000 and few.count() < 5 * (2 * (3000 // 300 + 2) + 1)


def test_ledger_of_events_dealt_by_time_is_written_where_it_is(spark, tmp_path):
    rows = spark.sql("select 'f' family, 's' source, id seq, timestamp_micros(1704067200000000 + id * 7919 % 864000 * 1000000) ts, 'k' sensor_key from range(5000)")
    dealt = routing.dealt(rows, by_time=True)
    days = dealt.groupBy(F.spark_partition_id()).agg(F.count_distinct(F.to_date("ts")).alias("n")).collect()
    assert len(days) > 16 and max(r["n"] for r in days) <= 2
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    write_ledger(dealt, str(tmp_path / "l"), by_time=True)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    back = spark.read.parquet(str(tmp_path / "l"))
    assert shown(back, *rows.columns) == shown(rows, *rows.columns) and back.where("day <> to_date(ts)").count() == 0
    # every task has written its own days; a shuffle by day would leave one small file a day
    assert len(list((tmp_path / "l").glob("day=*/*.parquet"))) == sum(r["n"] for r in days)


def test_targets_pair_messages_with_announcing_sensors_only(spark):
    meta = {"kind": "", "type": "t", "apiVersion": "v", "namespace": "n1"}
    says = {"target": ("events", {"message": "m"})}
    reg = sensors(
        spark, *[sensor(f"k{i}", "kafka", {"topic": "t"}, i) for i in range(8)], sensor("a", "kafka", {"topic": "t"}, 8, **says), sensor("b", "mqtt", {"topic": "#"}, 9, **says),
        sensor("old", "k8s_events", meta, 10, **says), sensor("owner", "k8s_events", meta, 11),
    )
    spans = runs(spark, *[(n, 0, None, 60) for n in (*[f"k{i}" for i in range(8)], "a", "b", "old", "owner")]).drop("idle_s")
    k8s = feed(spark, "k8s_events", ["s"]).withColumns({"kind": F.lit(""), "type": F.lit("t"), "version": F.lit("v")})
    feeds = given(spark) | {"k8s": k8s}
    del feeds["cron"]
    every, some = routing.route_all(reg, spans, **feeds), routing.route_all(reg, spans, only=targets.event_targets(reg), **feeds)
    columns = ["family", "seq", "ts", "sensor_key", "target_message"]
    want = shown(targets.target_events(every, reg), *columns)
    assert shown(targets.target_events(some, reg), *columns) == want and len(want) > 500
    assert {r["sensor_key"] for r in some.where("family <> 'k8s_events'").select("sensor_key").distinct().collect()} == {"ns/a", "ns/b"}
    assert not any("ns/old" in w for w in want)  # its key is owned by the one that registered last, which announces nothing


def test_ledger_stream_routes_messages_in_their_batch(spark, tmp_path):
    reg, spans = registry(spark), runs(spark, *GENERATIONS)
    plain, feeds = spans.drop("idle_s"), given(spark)
    ticks = routing.route_all(reg, plain, cron=feeds["cron"])
    events = ticks.unionByName(feeds["topics"], allowMissingColumns=True).unionByName(feeds["mqtt"], allowMissingColumns=True)
    mixed = routing.mixed_sensors(reg, plain)

    def route(batch):
        new = batch.where("generation is null").drop("sensor_key", "generation")
        parts = {"topics": new.where("family <> 'mqtt'"), "mqtt": new.where("family = 'mqtt'")}
        return routing.route_deciding(reg, plain, spans, done=batch.where("generation is not null"), mixed=mixed, **parts)

    base = "timestamp'2024-01-01' + make_dt_interval(0, 0, 0, {})"
    for begin, end in ((-1, 500), (500, 10**6)):
        events.where(F.expr(f"ts >= {base.format(begin)} and ts < {base.format(end)}")).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        ledger_stream(stream, reg, live(spark), spans, str(tmp_path / "out"), str(tmp_path / "check"), route=route).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/ledger"))
    assert shown(got, *actions.LEDGER) == shown(whole(spark, reg, spans), *actions.LEDGER)


LABELLED = ["family", "source", "seq", "ts", "sensor_key", "generation", "operation", "uuid", "labels"]


def labelled(df):
    return shown(df.withColumn("labels", map_text(F.col("labels"))), *LABELLED)


def test_labels_stream_routes_messages_in_their_batch(spark, tmp_path):
    """Uuids carry on over batches and within them, also for sensors of several topics, repeated sensors and rows routed before."""
    reg = registry(spark)
    spans = runs(spark, *GENERATIONS).drop("idle_s").unionByName(
        runs(spark, ("k0", 905, 1000, 60), ("k4", 2000, None, 60)).withColumn("generation", F.lit(2).cast("bigint")).drop("idle_s")
    )
    feeds, mixed = given(spark), routing.mixed_sensors(reg, spans)
    ticks = routing.route_all(reg, spans, cron=feeds["cron"])
    events = ticks.unionByName(feeds["topics"], allowMissingColumns=True).unionByName(feeds["mqtt"], allowMissingColumns=True)
    routes = routing.shared_routes(reg, spans, mixed)
    counts = []

    def route(batch):
        new = batch.where("generation is null").drop("sensor_key", "generation")
        parts = {"topics": new.where("family <> 'mqtt'"), "mqtt": new.where("family = 'mqtt'")}
        routed, few = routing.route_uuids(reg, spans, routes, mixed, batch.where("generation is not null"), **parts)
        counts.append((routed.where("uuid <> ''").count(), few.count()))
        return routed, few

    base = "timestamp'2024-01-01' + make_dt_interval(0, 0, 0, {})"
    for begin, end, columns in ((-1, 300, None), (300, 500, None), (500, 10**6, LABELLED)):
        events.where(F.expr(f"ts >= {base.format(begin)} and ts < {base.format(end)}")).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        labels_stream(stream, reg, str(tmp_path / "out"), str(tmp_path / "check"), route=route, columns=columns).awaitTermination()
    want = actions.merge_labels(actions.plan_actions(routing.route_all(reg, spans, **feeds), reg))
    assert labelled(spark.read.parquet(str(tmp_path / "out/labels"))) == labelled(want) and want.count() > 1500
    first = spark.read.parquet(str(tmp_path / "out/labels/batch=0"))
    assert set(first.columns) == set(want.columns)
    assert set(spark.read.parquet(str(tmp_path / "out/labels/batch=2")).columns) == set(LABELLED)
    # what a batch keeps is not a row per pair
    assert len(counts) == 3 and sum(few for _, few in counts) < sum(n for n, _ in counts) / 2


def test_last_uuids_do_not_grow_with_the_events_of_a_topic(spark):
    reg = sensors(spark, *[sensor(f"k{i}", "kafka", {"topic": "t"}, i) for i in range(5)])
    spans = runs(spark, *[(f"k{i}", i, 3000, 600) for i in range(5)]).drop("idle_s")
    none, mixed = spark.createDataFrame([], "sensor_key string"), routing.mixed_sensors(reg, spans)
    events = spark.sql("select 'kafka' family, id seq, timestamp_micros(1704067200000000 + id * 300000) ts, '' namespace, 't' source, '' type, '' version, '' data, concat('u', id) uuid from range(10000)")
    done = events.limit(0).join(none, F.lit(False), "left").withColumn("generation", F.lit(1).cast("bigint"))
    routed, few = routing.route_uuids(reg, spans, routing.shared_routes(reg, spans, mixed), mixed, done, events, events.limit(0))
    assert routed.count() > 49_000 and routed.where("last_uuid is null or last_uuid <> uuid").isEmpty()
    assert [(r["generation"], r["seq"], r["uuid"]) for r in few.collect()] == [(1, 9999, "u9999")] * 5


def test_labels_of_objects_that_have_names_of_event_labels(spark):
    pod, data = (actions.DEFAULTS.label(k) for k in ("pod-uuid", "event-data"))
    objects = spark.sql(f"select map('app', 'x', '{pod}', 'own', '{data}', 'old') object_labels union all select map('app', 'x') union all select cast(null as map<string,string>)")
    events = spark.sql("select 's' sensor_key, 1L generation, 'f' family, 's' source, id seq, timestamp'2024-01-01' ts, 'n' namespace, 't' type, 'v' version, 'd' data, u last_uuid, u uuid from values (1, 'u1'), (2, ''), (3, null) x(id, u)")
    got = {(r["seq"], len(r["object_labels"] or ())): r["labels"] for r in actions.merge_labels(events.crossJoin(objects)).collect()}
    event = {actions.DEFAULTS.label(k): v for k, v in (("action-timestamp", "1704067200000"), ("event-namespace", "n"), ("event-type", "t"), ("event-source", "s"), ("event-data", "d"), ("event-version", "v"))}
    for seq, uuid in ((1, {pod: "u1"}), (2, {}), (3, {})):
        assert got[seq, 3] == {"app": "x", pod: "own"} | event | uuid
        assert got[seq, 1] == {"app": "x"} | event | uuid
        assert got[seq, 0] is None

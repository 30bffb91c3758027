"""Which sensor gets which event: winners, fallbacks, fan-out, wildcards, hot keys."""

import pytest
from build import runs, sensor, sensors
from pyspark.sql import functions as F

from evspark.functions.columns import map_text
from evspark.operators import routing, state
from evspark.plans import actions
from evspark.session import as_table
from evspark.sources import feeds

TS = "timestamp'2024-01-01'"


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def k8s(spark, n=1):
    df = spark.sql(f"select 'ADD' op, '' kind, 'ns' namespace, 's' source, 'Normal' type, 'v1' api_version, 'm' message, id seq, {TS} ts from range({n})")
    return feeds.from_k8s_events(df, keep=("kind",))


def test_last_registered_cluster_sensor_wins(spark):
    meta = {"kind": "", "type": "Normal", "apiversion": "v1", "Namespace": "ns"}
    reg = sensors(spark, sensor("a", "k8s_events", meta, 1), sensor("b", "k8s_events", meta, 2), sensor("c", "cron", meta, 3))
    assert pairs(routing.route_k8s(k8s(spark), reg), "sensor_key") == [("ns/b",)]


def test_key_columns_are_not_confused_by_their_text(spark):
    # kind+type would read the same for both
    reg = sensors(spark, sensor("a", "k8s_events", {"kind": "Nor", "type": "mal", "apiVersion": "v1", "namespace": "ns"}))
    assert routing.route_k8s(k8s(spark), reg).count() == 0


def http(spark, rows):
    df = spark.createDataFrame(rows, "seq bigint, host string, method string, path string, headers map<string,string>")
    return feeds.from_http(df.selectExpr("*", "'' body", f"{TS} ts"), keep=("host", "method", "path", "headers"))


def test_first_registered_host_wins_and_headers_are_a_fallback(spark):
    reg = sensors(
        spark,
        sensor("late", "k8s_http", {"hosts": "h1,h2"}, 5),
        sensor("early", "k8s_http", {"hosts": "h1", "headers": "X-B=1"}, 2),
        sensor("head", "k8s_http", {"headers": "x-a=1,X-Long=p=q"}, 3),
    )
    reqs = http(spark, [
        (1, "h1", "GET", "/", {"x-a": "1"}), (2, "h2", "PUT", "/", {}), (3, "h1", "PATCH", "/", {}), (4, "h1", "GET", "/x", {}),
        (5, "h3", "GET", "/", {"X-B": "1", "X-A": "1"}), (6, "h3", "POST", "/", {"x-long": "p=q"}), (7, "h3", "GET", "/", {"X-A": "2"}),
        (8, "h1:80", "GET", "/", {}),
    ])
    assert pairs(routing.route_http(reqs, reg), "seq", "sensor_key") == [
        (1, "ns/early"), (2, "ns/late"), (5, "ns/head"), (6, "ns/head"),
    ]


def test_topics_fan_out(spark):
    reg = sensors(
        spark, sensor("a", "redis", {"channel": "c"}, 1), sensor("b", "redis", {"channel": "c"}, 2), sensor("k", "kafka", {"topic": "c"}, 3)
    )
    msgs = feeds.from_redis(spark.sql(f"select 'c' channel, 'p' payload, id seq, {TS} ts from range(3)"))
    assert pairs(routing.route_topic(msgs, reg), "seq", "sensor_key") == [(i, f"ns/{k}") for i in range(3) for k in "ab"]


FILTERS = {
    "#": {"a", "a/b", "a/b/c", "a//c", "testtopic/1"}, "a/#": {"a", "a/b", "a/b/c", "a//c"}, "a/+": {"a/b"}, "a/b": {"a/b"}, "+": {"a"},
    "+/b/#": {"a/b", "a/b/c"}, "a/+/c": {"a/b/c", "a//c"}, "testtopic/#": {"testtopic/1"}, "$SYS/#": {"$SYS/x"}, "+/+": {"a/b", "testtopic/1"},
    "a/#/c": set(), "a+": set(), "": set(),
}


@pytest.mark.parametrize("topic_filter", FILTERS)
def test_topic_filters(spark, topic_filter):
    reg = sensors(spark, sensor("m", "mqtt", {"topic": topic_filter}))
    topics = spark.createDataFrame([(t,) for t in ("a", "a/b", "a/b/c", "a//c", "testtopic/1", "$SYS/x")], "source string")
    assert {r["source"] for r in routing.mqtt_topic_routes(topics, reg).collect()} == FILTERS[topic_filter]


def test_unrouted_forms_agree(spark):
    meta = {"source": "s", "type": "t", "version": "1.0"}
    reg = sensors(spark, sensor("a", "cloud_events", meta))
    events = feeds.from_cloud_events(spark.sql(f"select 's' source, if(id = 1, 't', 'u') type, '1.0' specversion, '' data, id seq, {TS} ts from range(3)"))
    by_key = routing.unrouted_by_key(events, routing.cloud_routes(reg), routing.CLOUD_KEY)
    by_event = routing.unrouted(events, routing.route_cloud(events, reg))
    assert pairs(by_key, "seq") == pairs(by_event, "seq") == [(0,), (2,)]


def test_hot_route_key_is_split_when_routes_are_not_broadcast(spark):
    meta = {"kind": "", "type": "Normal", "apiVersion": "v1", "namespace": "ns"}
    reg = sensors(spark, *[sensor(f"s{i}", "k8s_events", meta | {"namespace": f"ns{i}" if i else "ns"}, i) for i in range(8)])
    df = spark.range(0, 40000, 1, 8).selectExpr(
        "'ADD' op", "'' kind", "if(id % 3 = 0, 'ns', concat('ns', id % 7 + 1)) namespace", "repeat(uuid(), 5) source",
        "'Normal' type", "'v1' api_version", "'m' message", "id seq", f"{TS} ts",
    )
    events = feeds.from_k8s_events(df, keep=("kind",))
    plain = routing.route_k8s(events, reg).groupBy("sensor_key").count()
    want = pairs(plain, "sensor_key", "count")
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        joined = routing.route_k8s(events, reg)
        assert pairs(joined.groupBy("sensor_key").count(), "sensor_key", "count") == want
        joined.select(F.max("source")).collect()
        final = routing.route_k8s(events, reg)
        final.collect()
        assert "skew=true" in final._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def day(n):
    return f"timestamp'2024-01-01' + make_dt_interval({n})"


def spans(spark, *rows):
    """Generations (sensor, number, first day, end day or None)."""
    sql = " union all ".join(f"select 'ns/{k}' sensor_key, bigint({g}) generation, {day(a)} valid_from, {'cast(null as timestamp)' if b is None else day(b)} valid_to" for k, g, a, b in rows)
    return spark.sql(sql)


def on_days(spark, *days):
    df = spark.createDataFrame([(d,) for d in days], "seq bigint")
    df = df.selectExpr("'ADD' op", "'' kind", "'ns' namespace", "'s' source", "'Normal' type", "'v1' api_version", "'m' message", "seq", "timestamp'2024-01-01' + make_dt_interval(int(seq)) ts")
    return feeds.from_k8s_events(df, keep=("kind",))


def test_last_registration_owns_the_key_until_it_ends(spark):
    """A, then B, then B stops: the key is free after that although A runs on; then A starts anew."""
    meta = {"kind": "", "type": "Normal", "apiVersion": "v1", "namespace": "ns"}
    reg = sensors(spark, sensor("a", "k8s_events", meta, 1), sensor("b", "k8s_events", meta, 2))
    gens = spans(spark, ("a", 1, 1, 30), ("b", 1, 10, 20), ("a", 2, 40, None))
    routed = routing.route_k8s_asof(on_days(spark, 0, 1, 5, 10, 15, 20, 25, 39, 40, 99), reg, gens)
    assert pairs(routed, "seq", "sensor_key", "generation") == [
        (1, "ns/a", 1), (5, "ns/a", 1), (10, "ns/b", 1), (15, "ns/b", 1), (40, "ns/a", 2), (99, "ns/a", 2),
    ]


def test_first_registration_owns_the_host_until_it_ends(spark):
    """B registers while A holds the host and gets nothing, even after A has stopped; C finds it free."""
    hosts = {"hosts": "h"}
    reg = sensors(spark, *[sensor(k, "k8s_http", hosts, i) for i, k in enumerate("abc")], sensor("head", "k8s_http", {"headers": "x-a=1"}, 9))
    gens = spans(spark, ("a", 1, 1, 10), ("b", 1, 5, 50), ("c", 1, 20, 30), ("head", 1, 0, None))
    df = spark.createDataFrame([(d, "h", "GET", "/", {"X-A": "1"}) for d in (0, 1, 9, 10, 15, 20, 35)], "seq bigint, host string, method string, path string, headers map<string,string>")
    reqs = feeds.from_http(df.selectExpr("*", "'' body", "timestamp'2024-01-01' + make_dt_interval(int(seq)) ts"), keep=("host", "method", "path", "headers"))
    assert pairs(routing.route_host_asof(reqs, reg, gens), "seq", "sensor_key") == [(1, "ns/a"), (9, "ns/a"), (20, "ns/c")]
    assert pairs(routing.route_http_asof(reqs, reg, gens), "seq", "sensor_key") == [
        (0, "ns/head"), (1, "ns/a"), (9, "ns/a"), (10, "ns/head"), (15, "ns/head"), (20, "ns/c"), (35, "ns/head"),
    ]


def test_requests_of_two_front_ends_are_not_merged(spark):
    reg = sensors(spark, sensor("head", "k8s_http", {"headers": "x-a=1,x-b=2"}))
    df = spark.createDataFrame([(1, "h", "one"), (1, "h", "two"), (1, "h", "two")], "seq bigint, host string, body string")
    reqs = feeds.from_http(df.selectExpr("*", "'GET' method", "'/' path", "map('X-A', '1', 'X-B', '2') headers", f"{TS} ts"), keep=("host", "method", "path", "headers"))
    assert pairs(routing.route_http_header(reqs, reg), "data") == [("one",), ("two",), ("two",)]


def test_route_all_reaches_every_family(spark):
    reg = sensors(spark, sensor("r", "redis", {"channel": "c"}), sensor("t", "cron", {"cron": "0 0 0 1 * *"}))
    gens = spans(spark, ("r", 1, 0, 1), ("r", 2, 2, None), ("t", 1, 0, None))
    msgs = feeds.from_redis(spark.sql("select 'c' channel, 'p' payload, id seq, timestamp'2024-01-01' + make_dt_interval(int(id)) ts from range(4)"))
    ticks = msgs.withColumns({"family": F.lit("cron"), "sensor_key": F.lit("ns/t")})
    got = routing.route_all(reg, gens, topics=msgs, cron=ticks)
    assert pairs(got, "family", "seq", "sensor_key", "generation") == [("cron", i, "ns/t", 1) for i in range(4)] + [("redis", 0, "ns/r", 1), ("redis", 2, "ns/r", 2), ("redis", 3, "ns/r", 2)]


def greedy(rows):
    """The first registration of a key, then always the next that begins when the last one taken has ended."""
    out = []
    for key in {r[0] for r in rows}:
        taken = []
        for r in sorted((r for r in rows if r[0] == key and (r[4] is None or r[1] < r[4])), key=lambda r: r[1:4]):
            if not taken or (taken[-1][4] is not None and taken[-1][4] <= r[1]):
                taken.append(r)
        out += taken
    return sorted(map(repr, out))


@pytest.mark.parametrize("listed", [1000, 3])
def test_first_come_equals_a_plain_walk(spark, listed):
    import random

    rng = random.Random(listed)
    rows = []
    for i in range(500):
        begin = rng.randrange(2000)
        rows.append((rng.choice(["hot"] * 6 + ["a", "b", "c"]), begin, i, f"ns/{i % 90}", rng.choice([None] + [begin + rng.randrange(0, 30)] * 60), 1 + i // 90))
    df = spark.createDataFrame(rows, "host string, a long, created_seq long, sensor_key string, b long, generation long")
    regs = df.selectExpr("host", "timestamp_seconds(a) valid_from", "created_seq", "sensor_key", "generation", "timestamp_seconds(b) valid_to")
    got = routing.first_come(regs, ["host"], listed)
    assert got.columns == ["host", *routing.ENTRY]
    found = got.selectExpr("host", "unix_seconds(valid_from) a", "created_seq", "sensor_key", "unix_seconds(valid_to) b", "generation").collect()
    assert sorted(repr(tuple(r)) for r in found) == greedy(rows)


def test_first_come_without_registrations(spark):
    regs = spark.createDataFrame([], "host string, valid_from timestamp, created_seq long, sensor_key string, generation long, valid_to timestamp")
    assert routing.first_come(regs, ["host"]).collect() == []


def test_fan_out_of_a_small_file_is_many_tasks(spark):
    reg = as_table(sensors(spark, *[sensor(f"s{i}", "redis", {"channel": "c"}, i) for i in range(3)], *[sensor(f"m{i}", "mqtt", {"topic": "c/#"}, i) for i in range(3)]))
    rows = spark.createDataFrame([("c", "p", i, i) for i in range(400)], "channel string, payload string, seq bigint, t bigint").coalesce(1)
    rows = rows.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    routed = routing.route_topic(feeds.from_redis(rows), reg)
    sizes = [r["count"] for r in routed.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1200 and len(sizes) > 4 and max(sizes) < 400
    routed = routing.route_mqtt(feeds.from_mqtt(rows.withColumnRenamed("channel", "topic")), reg)
    assert routed.count() == 1200 and "REPARTITION_BY_NUM" in routed._jdf.queryExecution().sparkPlan().toString()


def test_missed_events_are_those_traced_to_nobody(spark):
    reg = sensors(
        spark, *[sensor(n, "redis", {"channel": "c"}, i) for i, n in enumerate("abcd")], sensor("k", "k8s_events", {"kind": "", "type": "t"}, 9)
    )
    spans = spark.createDataFrame(
        [("ns/a", 1, 10, 40), ("ns/b", 1, 5, 20), ("ns/b", 2, 40, 45), ("ns/c", 1, 50, 50), ("ns/d", 1, 60, None), ("ns/a", 2, 70, 80), ("ns/k", 1, 3, 9)],
        "sensor_key string, generation bigint, a bigint, b bigint",
    ).select("sensor_key", "generation", F.timestamp_seconds("a").alias("valid_from"), F.timestamp_seconds("b").alias("valid_to"))
    rows = spark.createDataFrame([(c, "p", i, t) for i, (c, t) in enumerate((c, t) for c in ("c", "x", None) for t in (*range(0, 90, 5), None))], "channel string, payload string, seq bigint, t bigint")
    events = feeds.from_redis(rows.withColumn("ts", F.timestamp_seconds("t")).drop("t"))
    traced = routing.trace_all(reg, spans, topics=events)
    missed = routing.trace_all(reg, spans, missed=True, topics=events)
    assert missed.columns == traced.columns and [t for _, t in missed.dtypes] == [t for _, t in traced.dtypes]
    assert pairs(missed, "source", "seq", "ts") == pairs(traced.where("generation is null"), "source", "seq", "ts")
    assert sorted(r["seq"] for r in missed.where("source = 'c'").collect()) == [0, 9, 10, 11, 18]


def test_checks_need_few_pairs_of_hot_topics(spark):
    """Idle checks over all routed events and over those that block them are the same; pairs do not grow with the events of a topic."""
    reg = sensors(
        spark, *[sensor(f"k{i}", "kafka", {"topic": "t"}, i) for i in range(6)], sensor("all", "mqtt", {"topic": "#"}, 7),
        sensor("one", "mqtt", {"topic": "t"}, 8), sensor("cron", "cron", {"cron": "x"}, 9), sensor("other", "redis", {"channel": "t"}, 10),
    )
    names = [("k0", 0, 3600, 60), ("k1", 31, 3001, 45), ("k2", 0, None, 100), ("k3", 64, 128, 1), ("k4", 7, 1800, 86400), ("k5", 0, 3000, 8)]
    spans = runs(spark, *names, ("all", 3, 3600, 77), ("one", 0, None, 32), ("cron", 0, 400, 60))
    at = "timestamp_micros(1704067200000000 + cast({} as bigint) * 1000000)"
    # ten events a second in the first ten minutes and around the ends of slices and of generations, few later, some without a time
    sec = "if(id < 6000, id div 10, if(id % 97 = 0, null, element_at(array(1023, 1024, 1055, 1056, 1799, 1800, 2999, 3000, 3001), int(id % 9) + 1)))"
    events = {"kafka": "t", "mqtt": "t", "redis": "else"}
    feeds_ = {f: spark.sql(f"select '{f}' family, id seq, {at.format(sec)} ts, '' namespace, '{s}' source, '' type, '' version, '' data, '' uuid from range(6200)") for f, s in events.items()}
    ticks = feeds_["redis"].where("seq % 500 = 1").withColumn("sensor_key", F.lit("ns/cron"))
    given = {"topics": feeds_["kafka"].unionByName(feeds_["redis"]), "mqtt": feeds_["mqtt"], "cron": ticks}
    every = routing.route_all(reg, spans, **given)
    few = routing.route_all(reg, spans, spans, **given)
    shown = lambda r: pairs(state.idle_firings(r, spans, "2024-01-01 01:10:00"), "sensor_key", "fire_ts", "first_in_gap")
    want = shown(every)
    assert shown(few) == want and len({w[0] for w in want}) == 7
    # a period is longer than two slices of half its length at most, and each slice gives two events
    assert every.count() > 40_000 and few.count() < 4 * sum(((b or 4200) - a) // d + 2 for _, a, b, d in [*names, ("all", 3, 3600, 77), ("one", 0, None, 32)])


def test_facts_of_generations_are_found_before_pairing(spark):
    """Namespaces and labels are those of plans that gather all routed events, also for sensors of several topics or spans and repeated rows."""
    op = {"operation": "create"}
    reg = sensors(
        spark, *[sensor(f"k{i}", "kafka", {"topic": "t"}, i, **op) for i in range(4)], sensor("all", "mqtt", {"topic": "#"}, 7), sensor("one", "mqtt", {"topic": "m/+"}, 8),
        sensor("cron", "cron", {"cron": "x"}, 9), sensor("red", "redis", {"channel": "r"}, 10), sensor("red", "redis", {"channel": "r"}, 10),
        sensor("two", "kafka", {"topic": "t"}, 11), sensor("two", "kafka", {"topic": "u"}, 12), sensor("none", "kafka", {"topic": "v"}, 13),
    )
    spans = runs(
        spark, ("k0", 0, 100, 60), ("k1", 31, 80, 60), ("k2", 33, None, 60), ("k3", 10, 20, 60), ("k3", 50, 70, 60), ("all", 3, 90, 60), ("one", 0, None, 60),
        ("cron", 0, 90, 60), ("red", 5, 60, 60), ("two", 0, 90, 60), ("none", 0, 90, 60),
    ).drop("idle_s").unionByName(runs(spark, ("k0", 101, 160, 60), ("k2", 500, 600, 60)).withColumn("generation", F.lit(2).cast("bigint")).drop("idle_s"))

    def feed(family, sources):
        source = f"element_at(array({', '.join(repr(x) for x in sources)}), int(id % {len(sources)}) + 1)"
        at = f"if(id % 41 = 40, null, timestamp_micros(1704067200000000 + {'id' if family == 'mqtt' else '(id * 7 % 200)'} * 1000000)) ts"
        df = spark.sql(f"select '{family}' family, id seq, {at}, concat('n', id) namespace, {source} source, '' type, '' version, 'd' data, if(id % 9 = 4, concat('u', id), '') uuid from range(200)")
        return df.unionByName(df.where("seq % 10 = 4"))

    given = {
        "topics": feed("kafka", ["t", "t", "u"]).unionByName(feed("redis", ["r"])), "mqtt": feed("mqtt", ["m/a", "m/b", "x"]),
        "cron": feed("cron", ["c"]).withColumn("sensor_key", F.lit("ns/cron")),
    }
    labels = lambda r: actions.merge_labels(actions.resolve_namespace(actions.plan_actions(r, reg)))
    shown = lambda df: pairs(df.withColumn("labels", map_text(F.col("labels"))), "family", "source", "seq", "sensor_key", "generation", "target_namespace", "labels")
    got = labels(routing.route_all(reg, spans, facts=True, **given))
    want = shown(labels(routing.route_all(reg, spans, **given)))
    assert shown(got) == want and len(want) > 800 and {w[3] for w in want} == {f"ns/{n}" for n in ("k0", "k1", "k2", "k3", "all", "one", "cron", "red", "two")}

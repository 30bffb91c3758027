"""Routing of events to sensors.

Every join here is an equality join of events with a narrow table of routes. Spark broadcasts the
routes when their measured size is below its threshold and otherwise shuffles both sides, where AQE splits a hot
route key among tasks. Events that may each reach many sensors are dealt to many tasks first (:func:`dealt`). Where rules have
times, both sides also meet by slice of time (:func:`paired`).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.functions.columns import int_div, micros, option, text
from evspark.functions.ordered import last_value, next_value
from evspark.functions.ranged import place
from evspark.operators.meta import header_pairs, host_list
from evspark.session import as_table, small
from evspark.sources.envelope import COLUMNS, IDENTITY, ORDER

K8S_KEY = ["kind", "type", "version", "namespace"]
CLOUD_KEY = ["source", "type", "version"]
HOST_KEY = ["host"]
HEADER_KEY = ["header_name", "header_value"]
TOPIC_KEY = ["family", "source"]
RUN = ["sensor_key", "generation"]
# What the HTTP front accepts.
HTTP_METHODS = ("GET", "DELETE", "PUT", "POST")
HTTP_PATH = "/"
WHO = ("sensor_key", "created_seq")


def route_key(family: str) -> Column:
    """Display form of the composite key; joins use the separate columns."""
    if family == "k8s_events":
        return F.concat_ws("-", F.concat("kind", "type"), "version", "namespace")
    if family == "cloud_events":
        return F.concat_ws("-", *CLOUD_KEY)
    return F.col("source")


def _of_type(sensors: DataFrame, trigger: str, **cols: Column) -> DataFrame:
    return sensors.where(F.col("trigger.type") == trigger).select(*[c.alias(n) for n, c in cols.items()], *WHO)


def _option(name: str) -> Column:
    return text(option("trigger.meta", name))


def _who() -> Column:
    return F.struct("created_seq", "sensor_key")


def _last_registered(routes: DataFrame, key: list[str]) -> DataFrame:
    return routes.groupBy(*key).agg(F.max(_who()).alias("w")).select(*key, *[f"w.{c}" for c in WHO])


def _first_registered(routes: DataFrame, key: list[str]) -> DataFrame:
    return routes.groupBy(*key).agg(F.min(_who()).alias("w")).select(*key, *[f"w.{c}" for c in WHO])


def k8s_registrations(sensors: DataFrame) -> DataFrame:
    return _of_type(
        sensors, "k8s_events",
        kind=_option("kind"), type=_option("type"), version=_option("apiVersion"), namespace=_option("namespace"),
    )


def cloud_registrations(sensors: DataFrame) -> DataFrame:
    return _of_type(sensors, "cloud_events", source=_option("source"), type=_option("type"), version=_option("version"))


def k8s_routes(sensors: DataFrame) -> DataFrame:
    """Owner of each key when all sensors run."""
    return _last_registered(k8s_registrations(sensors), K8S_KEY)


def cloud_routes(sensors: DataFrame) -> DataFrame:
    """Owner of each key when all sensors run."""
    return _last_registered(cloud_registrations(sensors), CLOUD_KEY)


def route_k8s(events: DataFrame, sensors: DataFrame) -> DataFrame:
    """Cluster events (with their ``kind``) to the last sensor registered for the key."""
    return events.join(k8s_routes(sensors), K8S_KEY).select(*events.columns, *WHO)


def route_cloud(events: DataFrame, sensors: DataFrame) -> DataFrame:
    return events.join(cloud_routes(sensors), CLOUD_KEY).select(*events.columns, *WHO)


def host_registrations(sensors: DataFrame) -> DataFrame:
    return _of_type(sensors, "k8s_http", host=F.explode(host_list("trigger.meta")))


def header_registrations(sensors: DataFrame) -> DataFrame:
    pairs = _of_type(sensors, "k8s_http", h=F.explode(header_pairs("trigger.meta")))
    return pairs.select(F.lower("h.name").alias("header_name"), F.col("h.value").alias("header_value"), *WHO)


def host_routes(sensors: DataFrame) -> DataFrame:
    return _first_registered(host_registrations(sensors), HOST_KEY)


def header_routes(sensors: DataFrame) -> DataFrame:
    return _first_registered(header_registrations(sensors), HEADER_KEY)


def _acceptable() -> Column:
    return F.col("method").isin(*HTTP_METHODS) & (F.col("path") == HTTP_PATH)


def accepted(requests: DataFrame) -> DataFrame:
    return requests.where(_acceptable())


def route_http_host(requests: DataFrame, sensors: DataFrame) -> DataFrame:
    """Accepted requests to the first sensor registered for their host."""
    return accepted(requests).join(host_routes(sensors), "host").select(*requests.columns, *WHO)


def route_http_header(requests: DataFrame, sensors: DataFrame) -> DataFrame:
    """Requests without a host match to the sensor of their first matching header."""
    rest = _numbered(accepted(requests).join(host_routes(sensors).select("host"), "host", "left_anti"))
    hits = _headers(rest).join(header_routes(sensors), HEADER_KEY)
    return _first_header(rest, hits, WHO).select(*requests.columns, *WHO)


def _numbered(requests: DataFrame) -> DataFrame:
    """Requests with a digest of all their columns: equal numbers of two front ends are not one request."""
    plain = [F.to_json(c) if kind.startswith("map") else F.col(c) for c, kind in requests.dtypes]
    return requests.withColumn("_row", F.xxhash64(*plain))


def _headers(requests: DataFrame) -> DataFrame:
    """One narrow row per header; bodies stay behind."""
    return requests.select(*IDENTITY, "_row", "ts", F.explode(F.map_entries("headers")).alias("_h")).select(
        *IDENTITY, "_row", "ts", F.lower("_h.key").alias("header_name"), F.col("_h.value").alias("header_value")
    )


def _first_header(requests: DataFrame, hits: DataFrame, who: tuple | list, how: str = "inner") -> DataFrame:
    """Requests with the sensor of their first matching header by name; equal rows all stay."""
    first = F.min_by(F.struct(*who), F.struct("header_name", "created_seq"))
    winners = hits.groupBy(*IDENTITY, "_row").agg(first.alias("w")).select(*IDENTITY, "_row", *[f"w.{c}" for c in who])
    return requests.join(winners, [*IDENTITY, "_row"], how).drop("_row")


def route_http(requests: DataFrame, sensors: DataFrame) -> DataFrame:
    return route_http_host(requests, sensors).unionByName(route_http_header(requests, sensors))


DEALT_PER_CORE = 8


def dealt(events: DataFrame, by_time: bool = False) -> DataFrame:
    """Events in many tasks of equal size, for joins in which one may reach thousands of sensors.

    Tasks are cut by the size of what they read, and a small file of events is few of them. With ``by_time`` a task has the events
    of one range of time, and so have the pairs that it makes: a sink by day need not shuffle them.
    """
    if events.isStreaming:
        return events
    tasks = DEALT_PER_CORE * events.sparkSession.sparkContext.defaultParallelism
    return events.repartitionByRange(tasks, "ts") if by_time else events.repartition(tasks)


def topic_routes(sensors: DataFrame) -> DataFrame:
    kafka = _of_type(sensors, "kafka", family=F.lit("kafka"), source=_option("topic"))
    redis = _of_type(sensors, "redis", family=F.lit("redis"), source=_option("channel"))
    return kafka.unionByName(redis)


def route_topic(events: DataFrame, sensors: DataFrame) -> DataFrame:
    """Log and pub/sub messages to every sensor of their topic or channel."""
    return dealt(events).join(_to_all(topic_routes(sensors), events), ["family", "source"]).select(*events.columns, *WHO)


def _to_all(routes: DataFrame, events: DataFrame) -> DataFrame:
    """Routes of few keys, a row per sensor: broadcast, so that events, dealt already, are not shuffled again by those few keys and sorted."""
    return routes if events.isStreaming else small(as_table(routes))


def mqtt_filters(sensors: DataFrame) -> DataFrame:
    """Topic filters as depth, trailing ``#``, wildcard mask and the literal pattern."""
    parsed = (
        _of_type(sensors, "mqtt", topic_filter=_option("topic"))
        .where(F.col("topic_filter").rlike(r"^((\+|[^+#/]*)/)*(\+|#|[^+#/]*)$") & (F.col("topic_filter") != ""))
        .withColumn("levels", F.split("topic_filter", "/"))
        .withColumn("open_end", F.element_at("levels", -1) == "#")
        .withColumn("depth", F.size("levels") - F.col("open_end").cast("int"))
        .withColumn("body", F.slice("levels", F.lit(1), F.col("depth")))
    )
    return parsed.select(
        "open_end", "depth",
        F.array_join(F.transform("body", lambda t: F.when(t == "+", "+").otherwise(".")), "").alias("mask"),
        F.array_join("body", "/").alias("pattern"),
        "topic_filter", *WHO,
    )


def mqtt_topic_routes(topics: DataFrame, sensors: DataFrame) -> DataFrame:
    """Distinct topics (``source``) with the sensors whose filter matches.

    A topic is rewritten to the pattern it would have under each wildcard mask in use at
    each depth, and patterns are joined by equality; a depth d has at most 2^d masks.
    """
    filters = mqtt_filters(sensors)
    masks = filters.select("open_end", "depth", "mask").distinct()
    depths = topics.withColumn("levels", F.split("source", "/")).withColumn(
        "at",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit(False).alias("open_end"), F.size("levels").alias("depth"))),
                F.transform(
                    F.sequence(F.lit(0), F.size("levels")),
                    lambda d: F.struct(F.lit(True).alias("open_end"), d.alias("depth")),
                ),
            )
        ),
    ).select("source", "levels", "at.*")
    masked = depths.join(masks, ["open_end", "depth"]).withColumn(
        "pattern",
        F.array_join(
            F.transform(
                F.slice("levels", F.lit(1), F.col("depth")),
                lambda t, i: F.when(F.substr("mask", i + 1, F.lit(1)) == "+", "+").otherwise(t),
            ),
            "/",
        ),
    )
    # names beginning with $ are reserved: a leading wildcard does not match them
    wild_start = F.substring("topic_filter", 1, 1).isin("+", "#")
    return (
        masked.join(filters, ["open_end", "depth", "mask", "pattern"])
        .where(~(F.col("source").startswith("$") & wild_start))
        .select("source", "topic_filter", *WHO)
    )


def route_mqtt(events: DataFrame, sensors: DataFrame) -> DataFrame:
    """Messages to every sensor whose topic filter matches."""
    routes = mqtt_topic_routes(events.select("source").distinct(), sensors)
    return dealt(events).join(_to_all(routes.drop("topic_filter"), events), "source").select(*events.columns, *WHO)


def key_spans(registrations: DataFrame, generations: DataFrame, key: list[str], first_wins: bool = False) -> DataFrame:
    """Who owns a key when: key, sensor, generation, ``valid_from``, ``valid_to`` (null while it lasts).

    A generation registers the sensor's keys when it starts. Normally the last one to register owns the key until it
    ends or another registers; the key is free after that, also if an earlier sensor still runs. With
    ``first_wins`` a registration counts only if the key is free, and holds to its end. Spans of a
    key do not overlap. The others are put in order in one window per key.
    """
    regs = registrations.join(generations.select(*RUN, "valid_from", "valid_to"), "sensor_key")
    if first_wins:
        spans = first_come(regs, key)
    else:
        w = Window.partitionBy(*key).orderBy("valid_from", "created_seq", "sensor_key")
        spans = regs.withColumn("valid_to", F.least("valid_to", F.lead("valid_from").over(w)))
    return spans.where("valid_to is null or valid_from < valid_to").select(*key, *WHO, "generation", "valid_from", "valid_to")


LISTED = 1000
"""Most registrations of a key that are walked in one array."""


def first_come(regs: DataFrame, key: list[str], listed: int = LISTED) -> DataFrame:
    """Of the registrations of a key, in order, the first, and then always the next to begin when the one before has ended.

    Keys with up to ``listed`` registrations are walked in an array each. Beyond, registrations point to their successor, and what the
    first one reaches is found by doubling the pointers: a number of joins that grows with the logarithm of the chain, in which
    Spark splits a key of any size.
    """
    regs = regs.where("valid_to is null or valid_from < valid_to").select(*key, *ENTRY)
    sizes = regs.groupBy(*key).count()
    small = regs.join(sizes.where(F.col("count") <= listed), key).drop("count")
    large = sizes.where(F.col("count") > listed).select(*key)
    if large.isEmpty():
        return _walked(regs, key)
    return _walked(small, key).unionByName(_doubled(as_table(regs.join(large, key)), key))


ENTRY = ["valid_from", "created_seq", "sensor_key", "generation", "valid_to"]


def _walked(regs: DataFrame, key: list[str]) -> DataFrame:
    listed = regs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*ENTRY))).alias("r"))
    kind = listed.schema["r"].dataType.simpleString()

    def take(taken: Column, r: Column) -> Column:
        end = F.get(taken, F.size(taken) - 1)["valid_to"]
        return F.when((F.size(taken) == 0) | (end <= r["valid_from"]), F.concat(taken, F.array(r))).otherwise(taken)

    return listed.select(*key, F.explode(F.aggregate("r", F.array().cast(kind), take)).alias("r")).select(*key, "r.*")


def _doubled(regs: DataFrame, key: list[str]) -> DataFrame:
    me = F.struct(*ENTRY[:4])
    # ends ask for the next registration at or after them; they come before those of the same time
    asks = regs.where("valid_to is not null").select(*key, F.col("valid_to").alias("ts"), F.lit(0).alias("side"), me.alias("me"), F.lit(None).cast(_kind(regs, me)).alias("next"))
    offers = regs.select(*key, F.col("valid_from").alias("ts"), F.lit(1).alias("side"), me.alias("me"), me.alias("next"))
    found = place(asks.unionByName(offers), key, ["ts", "side", "me"]).scan(next=next_value(F.col("next"))).rows()
    jump = as_table(found.where("side = 0 and next is not null").select(*key, "me", "next"))
    reached = as_table(regs.groupBy(*key).agg(F.min(me).alias("me")))
    known = reached.count()
    while True:
        ahead = reached.join(jump, [*key, "me"]).select(*key, F.col("next").alias("me"))
        reached = as_table(reached.unionByName(ahead).distinct())
        before, known = known, reached.count()
        if known == before:
            break
        then = jump.select(*key, F.col("me").alias("next"), F.col("next").alias("then"))
        jump = as_table(jump.join(then, [*key, "next"]).select(*key, "me", F.col("then").alias("next")))
    return regs.withColumn("me", me).join(reached, [*key, "me"]).select(*key, *ENTRY)


def _kind(df: DataFrame, column: Column) -> str:
    return df.select(column.alias("c")).schema["c"].dataType.simpleString()


def _within() -> Column:
    return (F.col("ts") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("ts") < F.col("valid_to")))


def route_spans(events: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """Events with the sensor and generation whose span of the key holds at event time."""
    return events.join(spans, key).where(_within()).select(*events.columns, *RUN)


def route_k8s_asof(events: DataFrame, sensors: DataFrame, generations: DataFrame) -> DataFrame:
    return route_spans(events, key_spans(k8s_registrations(sensors), generations, K8S_KEY), K8S_KEY)


def route_cloud_asof(events: DataFrame, sensors: DataFrame, generations: DataFrame) -> DataFrame:
    return route_spans(events, key_spans(cloud_registrations(sensors), generations, CLOUD_KEY), CLOUD_KEY)


def route_host_asof(requests: DataFrame, sensors: DataFrame, generations: DataFrame) -> DataFrame:
    """Accepted requests to whoever owns their host at that time."""
    return route_spans(accepted(requests), key_spans(host_registrations(sensors), generations, HOST_KEY, True), HOST_KEY)


def route_header_asof(requests: DataFrame, sensors: DataFrame, generations: DataFrame) -> DataFrame:
    """Accepted requests whose host nobody owns at that time, to the owner of their first matching header."""
    owned = key_spans(host_registrations(sensors), generations, HOST_KEY, True).select(F.col("host").alias("_host"), "valid_from", "valid_to")
    rest = _numbered(accepted(requests).join(owned, (F.col("host") == F.col("_host")) & _within(), "left_anti"))
    spans = key_spans(header_registrations(sensors), generations, HEADER_KEY, True)
    hits = _headers(rest).join(spans, HEADER_KEY).where(_within())
    return _first_header(rest, hits, [*RUN]).select(*requests.columns, *RUN)


def route_http_asof(requests: DataFrame, sensors: DataFrame, generations: DataFrame) -> DataFrame:
    by_host, by_header = (f(requests, sensors, generations) for f in (route_host_asof, route_header_asof))
    return by_host.unionByName(by_header)


def trace_spans(events: DataFrame, spans: DataFrame, key: list[str], also: Column | None = None) -> DataFrame:
    """All events, with the sensors and generations whose span of the key holds at event time; nulls for those without any."""
    same = [F.col(c) == F.col(f"_{c}") for c in key]
    other = spans.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("sensor_key").alias("_sensor"), "generation", "valid_from", "valid_to")
    held = _within() if also is None else _within() & also
    found = events.join(other, reduce(Column.__and__, [*same, held]), "left")
    return found.select(*[F.col(c) for c in events.columns if c not in RUN], F.col("_sensor").alias("sensor_key"), "generation")


def trace_http(requests: DataFrame, sensors: DataFrame, generations: DataFrame) -> DataFrame:
    """All requests with the owner of their host or else of their first matching header, at request time."""
    hosts = key_spans(host_registrations(sensors), generations, HOST_KEY, True)
    by_host = trace_spans(requests, hosts, HOST_KEY, _acceptable())
    free = _numbered(by_host.where("generation is null").drop(*RUN))
    spans = key_spans(header_registrations(sensors), generations, HEADER_KEY, True)
    hits = _headers(free.where(_acceptable())).join(spans, HEADER_KEY).where(_within())
    by_header = _first_header(free, hits, [*RUN], "left")
    return by_host.where("generation is not null").unionByName(by_header)


def missed_spans(events: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """The rows of :func:`trace_spans` without a sensor. Spans of a key are merged first, so an event meets no two that hold at once."""
    w = Window.partitionBy(*key).orderBy("valid_from")
    end = F.struct(F.col("valid_to").isNull().alias("open"), "valid_to")
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = before.isNull() | (~before["open"] & (F.col("valid_from") > before["valid_to"]))
    merged = (
        spans.where("valid_from is not null and (valid_to is null or valid_from < valid_to)")
        .withColumn("_opens", opens.cast("int"))
        .withColumn("_group", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "_group")
        .agg(F.min("valid_from").alias("valid_from"), F.max(end).alias("_end"))
        .select(*[F.col(c).alias(f"_{c}") for c in key], "valid_from", "_end.valid_to")
    )
    same = [F.col(c) == F.col(f"_{c}") for c in key]
    left = events.join(merged, reduce(Column.__and__, [*same, _within()]), "left_anti")
    kinds = [(c, spans.schema[c].dataType) for c in RUN]
    return left.select(*[F.col(c) for c in events.columns if c not in RUN], *[F.lit(None).cast(kind).alias(c) for c, kind in kinds])


def _addressed(routes: DataFrame, generations: DataFrame) -> DataFrame:
    """Routes with the times of their sensors' generations."""
    return routes.join(generations.select(*RUN, "valid_from", "valid_to"), "sensor_key")


def _told(df: DataFrame, known: DataFrame | None) -> DataFrame:
    """Rows of sensors or generations with what is ``known`` of these."""
    return df if known is None else df.join(known, [c for c in RUN if c in known.columns])


def _marked(events: DataFrame, marks: DataFrame | None) -> DataFrame:
    return events if marks is None else events.join(marks, IDENTITY, "left")


SLICES = 16
"""Most slices of time that a route lies in, on average."""


def paired(events: DataFrame, routes: DataFrame, key: list[str]) -> DataFrame:
    """Events with the ``routes`` of ``key``, a stored table with times, that hold at their time.

    Both meet by key and slice of time, so an event is not compared with all routes that have its key at other times. Slices are cut between the
    first and the last time of routes; what goes on beyond lies in the last one.
    """
    begin, end = micros(F.col("valid_from")), micros(F.col("valid_to"))
    held = routes.where("valid_from is not null and (valid_to is null or valid_from < valid_to)")
    low, high, n = held.agg(F.min(begin), F.greatest(F.max(begin), F.max(end)), F.count("*")).first()
    if low is None:
        low, high, n = 0, 0, 1
    length = F.coalesce(end, F.lit(high)) - begin
    width = max(math.ceil((held.agg(F.sum(length.cast("double"))).first()[0] or 0) / (SLICES * n)), 1)
    last = (high - low) // width
    at = lambda us: F.least(int_div(us - F.lit(low), F.lit(width)), F.lit(last))
    slices = F.sequence(at(begin), F.coalesce(at(end - 1), F.lit(last)))
    cut = as_table(held.withColumn("_slice", F.explode(slices)))
    return events.withColumn("_slice", at(micros(F.col("ts")))).join(cut, [*key, "_slice"]).where(_within())


def _check_width() -> Column:
    """The largest power of two of microseconds that is no longer than the idle period ``idle_s``."""
    return F.expr(f"element_at(filter(array({', '.join(f'{2**i}L' for i in range(63))}), w -> w <= idle_s * 1000000), -1)")


def blocking_events(events: DataFrame, routes: DataFrame, key: list[str], runs: DataFrame) -> DataFrame:
    """Routed events of ``key`` (sensor, generation, ``ts``) that block the same idle checks as all of them.

    ``routes`` has a row per key and sensor, ``runs`` (``state.with_idle``) the generations with their period. Of the events of a key in a slice of time
    that is no longer than the period only the first and the last are paired with the sensors: a check whose period has
    any event of the slice has one of these. So pairs grow with the checks of the sensors, not with the events of their key.
    """
    to = as_table(routes.select(*key, "sensor_key").join(runs, "sensor_key").where("idle_s > 0").select(*key, *RUN, "valid_from", "valid_to", _check_width().alias("_w")))
    us = micros(F.col("ts"))
    ends = (
        events.select(*key, "ts").join(small(to.select(*key, "_w").distinct()), key)
        .groupBy(*key, "_w", int_div(us - F.pmod(us, F.col("_w")), F.col("_w")).alias("_slice"))
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
        .select(*key, "_w", F.explode(F.array_distinct(F.array("first", "last"))).alias("ts"))
    )
    return dealt(ends).join(to, [*key, "_w"]).where(_within()).select(*RUN, "ts")


def route_blocking(sensors: DataFrame, generations: DataFrame, runs: DataFrame, **feeds: DataFrame) -> DataFrame:
    """Of the rows of :func:`route_all` what idle checks need (sensor, generation, ``ts``): all of those families in which an event reaches one
    sensor, and the :func:`blocking_events` of topics and of filters, whose messages reach many.
    """
    parts = [route_all(sensors, generations, **one).select(*RUN, "ts")] if (one := {n: e for n, e in feeds.items() if n not in ("topics", "mqtt")}) else []
    if "topics" in feeds:
        parts.append(blocking_events(feeds["topics"], topic_routes(sensors), TOPIC_KEY, runs))
    if "mqtt" in feeds:
        matched = mqtt_topic_routes(feeds["mqtt"].select("source").distinct(), sensors).select("source", "topic_filter").distinct()
        messages = feeds["mqtt"].select("source", "ts").join(matched, "source")
        parts.append(blocking_events(messages, mqtt_filters(sensors), ["topic_filter"], runs))
    return reduce(DataFrame.unionByName, parts)


FACTS = ["first_namespace", "last_uuid"]


def _more(known: DataFrame | None) -> list[str]:
    return [] if known is None else [c for c in known.columns if c not in RUN]


def route_addressed(events: DataFrame, routes: DataFrame, key: list[str], generations: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """Events routed by ``key`` with what they need to know of others of their generation (``FACTS``), and what they are ``told`` of it.

    A generation has all events of its key in its time, so the last uuid is looked for once per event of the key and the first event once
    per start, in two ordered scans of events, before they are paired with the sensors.
    """
    to = as_table(_addressed(routes, generations).select(*key, *RUN, "valid_from", "valid_to"))
    timed = events.where("ts is not null")
    order = [c for c in ORDER if c not in key]
    starts = to.where("valid_from is not null").select(*key, F.col("valid_from").alias("ts")).distinct()
    narrow = [*dict.fromkeys([*key, *order, "namespace"])]
    marked = timed.select(*narrow, F.lit(1).alias("_event")).unionByName(starts.withColumn("_event", F.lit(0)), allowMissingColumns=True)
    after = next_value(F.when(F.col("_event") == 1, F.struct("ts", "namespace")))
    found = place(marked, key, [order[0], "_event", *order[1:]]).scan(_first=after).rows()
    firsts = found.where("_event = 0").select(*key, F.col("ts").alias("valid_from"), "_first")
    lives = F.col("valid_to").isNull() | (F.col("_first.ts") < F.col("valid_to"))
    known = as_table(_told(
        to.join(firsts, [*key, "valid_from"], "left")
        .select(*key, *RUN, "valid_from", "valid_to", F.when(lives, F.col("_first.namespace")).alias("first_namespace")), told
    ))
    seen = place(timed, key, order).scan(_uuid=last_value(F.when(F.col("uuid") != "", F.struct("uuid", "ts")))).rows()
    last = F.when(F.col("_uuid.ts") >= F.col("valid_from"), F.col("_uuid.uuid")).alias("last_uuid")
    return paired(dealt(seen), known, key).select(*COLUMNS, *RUN, "first_namespace", last, *_more(told))


def mixed_sensors(sensors: DataFrame, generations: DataFrame) -> DataFrame:
    """Sensors that come with several triggers or whose generations have several spans: their events are not those of one key."""
    trigger = F.struct("trigger.type", _option("topic"), _option("channel"))
    several = sensors.groupBy("sensor_key").agg(F.count_distinct(trigger).alias("n"))
    spans = generations.groupBy(*RUN).agg(F.count_distinct(F.struct("valid_from", "valid_to")).alias("n"))
    return as_table(reduce(DataFrame.unionByName, [df.where("n > 1").select("sensor_key") for df in (several, spans)]).distinct())


def route_facts(sensors: DataFrame, generations: DataFrame, known: DataFrame | None = None, **feeds: DataFrame) -> DataFrame:
    """The rows of :func:`route_all` with the namespace of the first event of their generation and its last non-empty uuid so far.

    Topics and filters go through :func:`route_addressed`. Families in which an event reaches one sensor are scanned after routing, and so
    are sensors that come with several triggers and generations with several spans: their events are not those of one key. ``known`` is
    that of :func:`route_all`.
    """
    mixed = mixed_sensors(sensors, generations)
    plain = sensors.join(mixed, "sensor_key", "left_anti")
    shared = {n: e for n, e in feeds.items() if n in ("topics", "mqtt")}
    single = {n: e for n, e in feeds.items() if n not in shared}
    routed = [route_all(sensors, generations, **single)] if single else []
    if shared and not mixed.isEmpty():
        routed.append(route_all(sensors.join(mixed, "sensor_key", "left_semi"), generations, **shared))
    parts = []
    if routed:
        placed = place(reduce(DataFrame.unionByName, routed), RUN, ORDER)
        first = placed.rows().groupBy(*RUN).agg(F.min_by("namespace", F.struct(*ORDER)).alias("first_namespace"))
        seen = placed.scan(last_uuid=last_value(F.nullif(F.col("uuid"), F.lit("")))).rows()
        parts.append(_told(seen.join(small(first), RUN).select(*COLUMNS, *RUN, *FACTS), known))
    if "topics" in feeds:
        parts.append(route_addressed(feeds["topics"], topic_routes(plain), TOPIC_KEY, generations, known))
    if "mqtt" in feeds:
        matched = mqtt_topic_routes(feeds["mqtt"].select("source").distinct(), plain).select("source", "topic_filter").distinct()
        parts.append(route_addressed(feeds["mqtt"].join(matched, "source"), mqtt_filters(plain), ["topic_filter"], generations, known))
    return reduce(DataFrame.unionByName, parts)


DECIDING = [*ORDER, "namespace", "uuid", *RUN]
FOREVER = "9999-12-31 00:00:00"


def deciding_events(events: DataFrame, routes: DataFrame, key: list[str], generations: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Of the events routed by ``key`` (``DECIDING``) the first and the last with a uuid of each generation, found from one ordered scan of
    the events with the starts and ends; given ``runs``, with a row per generation and period, also those that begin and end a slice of
    time that is no longer than the period.

    An event that follows an idle check without events begins its slice, since an earlier one there would lie in the period before,
    and each period with events has a slice's first or last one, but for a period that the end of the generation cuts off.
    """
    to = as_table(_addressed(routes, generations).select(*key, *RUN, "valid_from", "valid_to"))
    order = [c for c in ORDER if c not in key]
    narrow = [*ORDER, "namespace", "uuid"]
    columns = [*dict.fromkeys([*key, *narrow])]
    timed = events.where("ts is not null").select(*columns)
    row = F.struct(*narrow)
    end = F.coalesce("valid_to", F.lit(FOREVER).cast("timestamp"))
    marks = to.select(*key, F.explode(F.array("valid_from", end)).alias("ts")).where("ts is not null").distinct()
    marked = timed.withColumn("_event", F.lit(1)).unionByName(marks.withColumn("_event", F.lit(0)), allowMissingColumns=True)
    found = place(marked, key, ["ts", "_event", *order[1:], "namespace"]).scan(
        _first=next_value(F.when(F.col("_event") == 1, row)), _last=last_value(F.when((F.col("_event") == 1) & (F.col("uuid") != ""), row))
    )
    here = as_table(found.where("_event = 0").rows().select(*key, "ts", "_first", "_last"))
    ends = {"_first": F.col("valid_from"), "_last": end}
    parts = [
        to.withColumn("_at", at).join(here.withColumnRenamed("ts", "_at"), [*key, "_at"])
        .select(*RUN, "valid_from", "valid_to", f"{side}.*").where(_within()).select(*DECIDING)
        for side, at in ends.items()
    ]
    if runs is not None:
        slices = as_table(
            routes.select(*key, "sensor_key").join(runs, "sensor_key").where("idle_s > 0")
            .select(*key, *RUN, "valid_from", "valid_to", _check_width().alias("_w"))
        )
        us = micros(F.col("ts"))
        of_slice = (
            timed.join(small(slices.select(*key, "_w").distinct()), key)
            .groupBy(*key, "_w", int_div(us - F.pmod(us, F.col("_w")), F.col("_w")).alias("_slice"))
            .agg(F.min(row).alias("first"), F.max(row).alias("last"))
            .select(*key, "_w", F.explode(F.array_distinct(F.array("first", "last"))).alias("_row"))
            .select(*key, "_w", *[F.col(f"_row.{c}").alias(c) for c in narrow if c not in key])
        )
        parts.append(dealt(of_slice).join(slices, [*key, "_w"]).where(_within()).select(*DECIDING))
    return reduce(DataFrame.unionByName, parts)


# what is known of sensors or generations, and of events, given the rows that decide it
Know = Callable[[DataFrame], tuple[DataFrame, DataFrame | None]]


def route_deciding(
    sensors: DataFrame, generations: DataFrame, runs: DataFrame | None = None, by_time: bool = False, done: DataFrame | None = None,
    mixed: DataFrame | None = None, only: DataFrame | None = None, know: Know | None = None, **feeds: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`route_all`, and of these (``DECIDING``) the few that decide what plans need to know of a generation: its first event,
    its last uuid and, for the generations in ``runs`` (``state.with_idle``), which idle checks its events block and which event follows one.

    Families in which an event reaches one sensor, and sensors with several triggers or spans, have all their rows in the second table too.
    ``done`` are rows of such families that are routed already; ``mixed`` are such sensors if they are known (:func:`mixed_sensors`). ``only`` is
    that of :func:`route_all`. What ``know`` finds in the second table goes into the first as ``known`` and ``marks`` of :func:`route_all`.
    """
    shared = {n: e for n, e in feeds.items() if n in ("topics", "mqtt")}
    single = {n: e for n, e in feeds.items() if n not in shared}
    mixed = mixed_sensors(sensors, generations) if mixed is None else mixed
    heard = _heard(sensors, only)
    plain = heard.join(mixed, "sensor_key", "left_anti")
    ready = [] if done is None else [done]
    if single:
        ready.append(as_table(route_all(sensors, generations, **single)))
    few = [one.select(*DECIDING) for one in ready]
    if shared and not mixed.isEmpty():
        few.append(route_all(heard.join(mixed, "sensor_key", "left_semi"), generations, **shared).select(*DECIDING))
    if "topics" in feeds:
        few.append(deciding_events(feeds["topics"], topic_routes(plain), TOPIC_KEY, generations, runs))
    if "mqtt" in feeds:
        matched = mqtt_topic_routes(feeds["mqtt"].select("source").distinct(), plain).select("source", "topic_filter").distinct()
        few.append(deciding_events(feeds["mqtt"].join(matched, "source"), mqtt_filters(plain), ["topic_filter"], generations, runs))
    few = reduce(DataFrame.unionByName, few)
    known, marks = (None, None) if know is None else know(few)
    routed = [_told(_marked(one, marks), known) for one in ready]
    if shared:
        routed.append(route_all(sensors, generations, by_time=by_time, only=only, known=known, marks=marks, **shared))
    return reduce(DataFrame.unionByName, routed), few


SCANNED = ["_by", "_key", "_number"]


def shared_routes(sensors: DataFrame, generations: DataFrame, mixed: DataFrame) -> DataFrame:
    """Routes of topics and of filters with the times of their generations, but those of ``mixed`` sensors, for :func:`route_uuids`."""
    plain = sensors.join(mixed, "sensor_key", "left_anti")
    by_topic = topic_routes(plain).select(F.col("family").alias("_by"), F.col("source").alias("_key"), "sensor_key")
    by_filter = mqtt_filters(plain).select(F.lit("mqtt").alias("_by"), F.col("topic_filter").alias("_key"), "sensor_key")
    to = _addressed(by_topic.unionByName(by_filter), generations)
    return as_table(to.select("_by", "_key", F.lit(0).cast("bigint").alias("_number"), *RUN, "valid_from", "valid_to"))


def route_uuids(
    sensors: DataFrame, generations: DataFrame, routes: DataFrame, mixed: DataFrame, done: DataFrame, topics: DataFrame, mqtt: DataFrame,
    known: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`route_all` with ``last_uuid``, the last non-empty uuid of their generation so far, and (``ORDER``, uuid, generation) the
    few events of which one is the last with a uuid of each generation.

    All is one ordered scan of events, before they are paired with the sensors: of messages by topic or filter, with the ends of its
    generations, and of rows that are ``done``, routed already, and those of ``mixed`` sensors (:func:`mixed_sensors`) by generation.
    ``routes`` are :func:`shared_routes`, ``known`` is that of :func:`route_all`.
    """
    own = sensors.join(mixed, "sensor_key", "left_semi")
    alone = done if mixed.isEmpty() else done.unionByName(route_all(own, generations, topics=topics, mqtt=mqtt))
    matched = mqtt_topic_routes(mqtt.select("source").distinct(), sensors).select("source", "topic_filter").distinct()
    by = lambda df, *key: df.where("ts is not null").select(*COLUMNS, *[k.alias(n) for k, n in zip(key, SCANNED, strict=True)], F.lit(1).alias("_event"))
    none = F.lit(0).cast("bigint")
    end = F.coalesce("valid_to", F.lit(FOREVER).cast("timestamp")).alias("ts")
    events = [
        by(topics.where("source is not null"), F.col("family"), F.col("source"), none),
        by(mqtt.join(matched, "source"), F.lit("mqtt"), F.col("topic_filter"), none),
        by(alone, F.lit(""), F.col("sensor_key"), F.col("generation")),
    ]
    marks = routes.select(*SCANNED, end).distinct().withColumn("_event", F.lit(0))
    marked = reduce(DataFrame.unionByName, events).unionByName(marks, allowMissingColumns=True)
    # an end comes before the events of its time, which are not of its generation
    last = last_value(F.when((F.col("_event") == 1) & (F.col("uuid") != ""), F.struct(*ORDER, "uuid")))
    found = place(marked, SCANNED, ["ts", "_event", *[c for c in ORDER if c != "ts"]]).scan(_last=last).rows()
    begun = F.col("_last.ts") >= F.col("valid_from")
    seen, single = found.where("_event = 1 and _by <> ''"), found.where("_event = 1 and _by = ''")
    to = routes if known is None else as_table(_told(routes, known))
    many = paired(dealt(seen), to, SCANNED).select(*COLUMNS, *RUN, F.when(begun, F.col("_last.uuid")).alias("last_uuid"), *_more(known))
    one = single.select(*COLUMNS, F.col("_key").alias("sensor_key"), F.col("_number").alias("generation"), F.col("_last.uuid").alias("last_uuid"))
    routed = many.unionByName(_told(one, known))
    at_end = found.where("_event = 0").select(*SCANNED, F.col("ts").alias("_end"), "_last")
    few = routes.withColumn("_end", end).join(at_end, [*SCANNED, "_end"]).where(begun).select("_last.*", *RUN)
    return routed, few.unionByName(alone.where("ts is not null and uuid <> ''").select(*ORDER, "uuid", *RUN))


def _heard(sensors: DataFrame, only: DataFrame | None) -> DataFrame:
    return sensors if only is None else sensors.join(only.select("sensor_key").distinct(), "sensor_key", "left_semi")


def trace_all(
    sensors: DataFrame, generations: DataFrame, missed: bool = False, by_time: bool = False, only: DataFrame | None = None, **feeds: DataFrame
) -> DataFrame:
    """All events of all feeds given (k8s, cloud, http, topics, mqtt, cron) with the sensors and generations that they reach, or nulls.

    With ``missed`` only those that reach none, and events are not paired with the sensors that they do reach. Each feed has the
    envelope and what its routing needs: ``kind`` for k8s, ``host``, ``method``, ``path`` and ``headers`` for http, ``sensor_key`` for
    cron. A feed is read once, but mqtt for its distinct topics and http for its two ways. ``by_time`` is that of :func:`dealt`.
    Given ``only`` (``sensor_key``), messages of topics and filters, which reach all their sensors, are paired with these sensors alone; a
    key that has one owner is still owned by whoever of all sensors has it.
    """
    trace = missed_spans if missed else trace_spans
    fan = (lambda e: e) if missed else (lambda e: dealt(e, by_time))
    heard = _heard(sensors, only)
    ways = {
        "k8s": lambda e: trace(e, key_spans(k8s_registrations(sensors), generations, K8S_KEY), K8S_KEY),
        "cloud": lambda e: trace(e, key_spans(cloud_registrations(sensors), generations, CLOUD_KEY), CLOUD_KEY),
        "http": lambda e: trace_http(e, sensors, generations),
        # stored, as Spark takes a join for the product of its sides and would shuffle the events by their few topics
        "topics": lambda e: trace(fan(e), as_table(_addressed(topic_routes(heard), generations)), TOPIC_KEY),
        "mqtt": lambda e: trace(fan(e), _addressed(mqtt_topic_routes(e.select("source").distinct(), heard), generations), ["source"]),
        "cron": lambda e: trace(e.withColumn("to", F.col("sensor_key")), generations.withColumn("to", F.col("sensor_key")), ["to"]),
    }
    traced = reduce(DataFrame.unionByName, [ways[name](events).select(*COLUMNS, *RUN) for name, events in feeds.items()])
    return traced.where("generation is null") if missed else traced


def route_all(
    sensors: DataFrame, generations: DataFrame, checks: DataFrame | None = None, facts: bool = False, by_time: bool = False,
    only: DataFrame | None = None, known: DataFrame | None = None, marks: DataFrame | None = None, **feeds: DataFrame,
) -> DataFrame:
    """The rows of :func:`trace_all` that reach a sensor; given the generations with their periods as ``checks``, :func:`route_blocking`.

    With ``facts`` they have two more columns, those of :func:`route_facts`. Given ``only``, rows of other sensors may be missing. ``known`` is a
    table by sensor or generation whose columns the rows have too, and ``marks`` one by event, which need not have a row of each. A message has its marks, and a route
    what is known, before messages are paired with routes, so nothing is looked up per pair.
    """
    if facts:
        return route_facts(sensors, generations, known, **feeds)
    if checks is not None:
        return route_blocking(sensors, generations, checks, **feeds)
    heard = _heard(sensors, only)
    ways = {
        "topics": lambda e: (topic_routes(heard), TOPIC_KEY),
        "mqtt": lambda e: (mqtt_topic_routes(e.select("source").distinct(), heard).drop("topic_filter"), ["source"]),
    }
    columns = [*COLUMNS, *([c for c in marks.columns if c not in IDENTITY] if marks is not None else []), *RUN, *_more(known)]
    single = {name: e for name, e in feeds.items() if name not in ways}
    parts = []
    if single:
        one = trace_all(sensors, generations, **single).where("generation is not null")
        parts.append(_told(_marked(one, marks), known).select(*columns))
    for name, way in ways.items():
        if name in feeds:
            routes, key = way(feeds[name])
            to = as_table(_told(_addressed(routes, generations).drop("created_seq"), known))
            parts.append(paired(dealt(_marked(feeds[name].select(*COLUMNS), marks), by_time), to, key).select(*columns))
    return reduce(DataFrame.unionByName, parts)


def unrouted(events: DataFrame, routed: DataFrame) -> DataFrame:
    """Events that reached no sensor, by event identity."""
    return events.join(routed.select(*IDENTITY), IDENTITY, "left_anti")


def unrouted_by_key(events: DataFrame, routes: DataFrame, key: list[str]) -> DataFrame:
    """Events whose key has no route; compares with the small route table only."""
    return events.join(routes.select(*key), key, "left_anti").select(*events.columns)

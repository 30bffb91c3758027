"""Action plans, labels, targets and endpoints on literal rows."""

import datetime as dt

import pytest
from build import manifest, routed, runs, sensor, sensors
from pyspark.sql import functions as F

from evspark.operators import state
from evspark.plans import actions, endpoints, targets
from evspark.settings import DEFAULTS
from evspark.streaming.sinks import write_ledger

CRON = {"cron": "x"}
HORIZON = "2024-01-02 00:00:00"


def registry(spark, **kinds):
    """Sensors name=(operation, manifest keywords)."""
    return sensors(spark, *[sensor(n, "cron", CRON, i, operation=op, body=manifest(**kw)) for i, (n, (op, kw)) in enumerate(kinds.items())])


def live(spark, *rows):
    return spark.createDataFrame(list(rows), "kind string, namespace string, name string, replicas int")


def test_unknown_operations_are_errors(spark):
    reg = registry(spark, a=("update", {}), b=("", {}), c=("scale", {}))
    plan = actions.plan_actions(routed(spark, [("a", 1), ("b", 2), ("c", 3)]), reg).orderBy("seq").collect()
    assert [(r["action"], r["error"]) for r in plan] == [("none", "operation.not_known"), ("none", "operation.not_known"), ("scale_up", None)]


def test_first_namespace_sticks(spark):
    reg = registry(spark, a=("create", {}), b=("create", {}), c=("create", {"namespace": "own"}), d=("create", {"kind": "Namespace", "namespace": "x"}))
    ev = routed(spark, [("a", 2, {"namespace": "y"}), ("a", 1, {"namespace": "x"}), ("b", 1), ("b", 2, {"namespace": "y"}), ("c", 1, {"namespace": "z"}), ("d", 1)])
    got = actions.resolve_namespace(actions.plan_actions(ev, reg)).collect()
    assert {r["seq"]: r["target_namespace"] for r in got} == {0: "x", 1: "x", 2: "default", 3: "default", 4: "own", 5: ""}


@pytest.mark.parametrize("width", [10**9, 2])
def test_uuid_is_carried_and_labels_overwritten(spark, width):
    clash = DEFAULTS.label("event-data")
    reg = registry(spark, a=("create", {"labels": {"app": "x", clash: "old"}}))
    ev = routed(spark, [("a", i, {"uuid": u}) for i, u in enumerate(["", "u1", "", "u2", ""])])
    merged = actions.merge_labels(actions.plan_actions(ev, reg), slice_width=width).orderBy("seq").collect()
    assert [r["labels"].get(DEFAULTS.label("pod-uuid")) for r in merged] == [None, "u1", "u1", "u2", "u2"]
    assert merged[0]["labels"]["app"] == "x" and merged[0]["labels"][clash] == "d"
    assert merged[1]["labels"][DEFAULTS.label("action-timestamp")] == "1704067201000"


def test_env_per_container_of_typed_kinds(spark):
    reg = registry(spark, a=("create", {"kind": "Pod", "containers": ["x", "y"]}), b=("create", {"kind": "Job", "containers": ["z"]}), c=("create", {}))
    ev = actions.event_env(actions.plan_actions(routed(spark, [("a", 1), ("b", 2), ("c", 3)]), reg)).collect()
    assert sorted(r["container"] for r in ev) == ["x", "y", "z"]
    names = [e["name"] for e in ev[0]["env"]]
    assert names == sorted(names) and len(names) == 6
    plan = actions.plan_create(actions.resolve_namespace(actions.plan_actions(routed(spark, [("a", 1), ("c", 3)]), reg))).orderBy("seq").collect()
    assert [(r["client"], r["n_containers"]) for r in plan] == [("typed", 2), ("generic", 0)]


def test_only_the_first_delete_finds_the_object(spark):
    reg = registry(spark, a=("delete", {"name": "o"}), b=("delete", {"name": "o"}), c=("delete", {"name": "gone"}))
    ev = routed(spark, [("a", 3), ("b", 2), ("b", 4), ("c", 1)])
    got = actions.plan_delete(actions.plan_actions(ev, reg), live(spark, ("Deployment", "default", "o", 1))).collect()
    assert {r["seq"]: (r["action"], r["outcome"]) for r in got} == {0: ("none", "noop"), 1: ("delete", "ok"), 2: ("none", "noop"), 3: ("none", "noop")}


def test_scaling_follows_idle_firings(spark):
    reg = registry(
        spark, new=("scale", {"name": "new"}), zero=("scale", {"name": "zero", "replicas": 0}), up=("scale", {"name": "up", "kind": "StatefulSet"}),
        down=("scale", {"name": "down"}), job=("scale", {"name": "j", "kind": "Job"}),
    )
    spans = runs(spark, *[(k, 0, 1000, 60) for k in ("new", "zero", "up", "down", "job")])
    ev = routed(spark, [
        ("new", 10), ("new", 70), ("new", 110), ("new", 300),  # checks at 180 and 240 fire before the last
        ("zero", 10), ("up", 10), ("up", 60), ("up", 180), ("up", 181), ("down", 200), ("job", 5), ("job", 6),
    ])
    res = live(spark, ("StatefulSet", "default", "up", 3), ("Deployment", "default", "down", 3), ("Deployment", "elsewhere", "new", 3))
    plan = actions.plan_actions(ev, reg)
    got = actions.plan_scale_up(plan, res, spans).orderBy("seq").collect()
    assert [(r["action"], r["outcome"]) for r in got] == [
        ("create", "ok"), ("none", "noop"), ("none", "noop"), ("patch", "ok"),
        ("create+patch", "ok"), ("none", "noop"), ("none", "noop"), ("patch", "ok"), ("none", "noop"), ("patch", "ok"),
        ("create", "error"), ("none", "error"),
    ]
    ledger = actions.action_ledger(plan, res, spans)
    assert ledger.orderBy("seq").collect() == got
    summary = {(r["sensor_key"], r["outcome"]): r["n"] for r in actions.ledger_summary(ledger).collect()}
    assert summary[("ns/new", "noop")] == 2 and summary[("ns/job", "error")] == 2


def test_scale_to_zero(spark):
    reg = registry(
        spark, dep=("create", {"name": "dep"}), absent=("update", {"name": "absent"}), sts=("update", {"name": "sts", "kind": "StatefulSet"}),
        made=("scale", {"name": "made", "kind": "StatefulSet"}), job=("create", {"name": "j", "kind": "Job"}), deleted=("delete", {"name": "deleted"}),
    )
    spans = runs(spark, *[(k, 0, 120, 60) for k in ("dep", "absent", "sts", "made", "job", "deleted")])
    ev = routed(spark, [("made", 30, {"namespace": "n1"}), ("deleted", 60)])
    res = live(spark, ("Deployment", "default", "dep", 0), ("Deployment", "default", "deleted", 1))
    got = actions.plan_scale_zero(state.idle_gaps(ev, spans, HORIZON), ev, reg, res).collect()
    shown = sorted((r["name"], r["fire_ts"].minute, r["target_namespace"], r["action"], r["outcome"], r["error"]) for r in got)
    assert shown == sorted([
        ("dep", 1, "default", "patch_zero", "ok", None), ("dep", 2, "default", "patch_zero", "ok", None),
        ("absent", 1, "default", "none", "noop", None), ("absent", 2, "default", "none", "noop", None),
        ("sts", 1, "default", "none", "error", "object.not_found"), ("sts", 2, "default", "none", "error", "object.not_found"),
        ("made", 2, "n1", "patch_zero", "ok", None),
        ("j", 1, "default", "none", "error", "kind.not_scalable"), ("j", 2, "default", "none", "error", "kind.not_scalable"),
        ("deleted", 2, "default", "none", "noop", None),
    ], key=lambda r: r[:2])


def test_targets_follow_failed_events_too(spark):
    reg = sensors(
        spark, sensor("a", "cron", CRON, 1, operation="update", target=("events", {"namespace": "n", "Message": "m"})),
        sensor("b", "cron", CRON, 2), sensor("c", "cron", CRON, 3, target=("http", {"url": "u"})),
    )
    ledger = actions.plan_actions(routed(spark, [("a", 1), ("a", 2), ("b", 1), ("c", 1)]), reg)
    got = targets.target_events(ledger, reg).collect()
    assert [(r["sensor_key"], r["target_namespace"], r["target_message"], r["target_reason"]) for r in got] == [("ns/a", "n", "m", "")] * 2


def test_ledger_is_written_by_day(spark, tmp_path):
    rows = routed(spark, [("a", 1), ("a", 90000)])
    write_ledger(rows, str(tmp_path / "l"))
    write_ledger(rows, str(tmp_path / "l"))
    back = spark.read.parquet(str(tmp_path / "l"))
    assert back.count() == 4 and back.where("day = date'2024-01-02'").count() == 2


# endpoints

POD = ("pod string, namespace string, labels map<string,string>, container_statuses array<boolean>,"
       " containers array<struct<name:string,ports:array<struct<name:string,port:int>>>>, pod_ip string, seq bigint, sec double")


def at(sec):
    return f"timestamp'2024-01-01' + make_dt_interval(0, 0, 0, cast({sec} as decimal(18,6)))"


def pods(spark, *rows):
    """(pod, seconds, statuses, overrides)"""
    data = []
    for i, (pod, sec, ready, *more) in enumerate(rows):
        o = {"labels": {"app": "x", "t": "1"}, "ports": [("web", 80), ("http", 8080)], "ip": "10.0.0.1", "ns": "n"} | (more[0] if more else {})
        data.append((pod, o["ns"], o["labels"], ready, [("c", o["ports"])], o["ip"], i, float(sec)))
    return spark.createDataFrame(data, POD).withColumn("ts", F.expr(at("sec"))).drop("sec")


def test_readiness_and_ports(spark):
    df = pods(
        spark, ("p", 0, [True, True]), ("p", 1, [True, False]), ("p", 2, []), ("http", 3, [True]),
        ("p", 4, [True], {"ip": ""}), ("p", 5, [True], {"ports": []}), ("p", 6, [True], {"ports": [("a", 1), ("b", 2)]}),
    )
    by_port = endpoints.ready_endpoints(df).orderBy("seq").collect()
    assert [r["ready"] for r in by_port] == [True, False, False, True, True, True, True]
    assert [r["endpoint"] for r in by_port] == ["10.0.0.1:8080"] * 4 + [None, "10.0.0.1:0", "10.0.0.1:1"]
    assert [r["no_address"] for r in by_port] == [False] * 4 + [True, False, False]
    by_pod = [r["endpoint"] for r in endpoints.ready_endpoints(df, "pod").orderBy("seq").collect()]
    assert by_pod[0] == "10.0.0.1:80" and by_pod[3] == "10.0.0.1:8080"


def test_selectors(spark):
    df = pods(spark, ("p", 0, [True]), ("q", 0, [True], {"labels": {"app": "x"}}), ("r", 0, [True], {"labels": {}}), ("s", 0, [True], {"ns": "m"}))
    def match(selector):
        sel = spark.createDataFrame([("n", selector)], "namespace string, selector map<string,string>")
        keys = df.select("namespace", "pod", F.to_json(endpoints.sorted_entries(F.col("labels"))).alias("labels_key"))
        return sorted(r["pod"] for r in endpoints.select_pods(df, sel).join(keys, ["namespace", "labels_key"]).collect())

    assert match({"app": "x"}) == ["p", "q"]
    assert match({"t": "1", "app": "x"}) == ["p"]
    assert match({"app": "y"}) == []
    assert match({}) == ["p", "q", "r"]


def test_common_label_does_not_pair_all_its_holders(spark):
    df = spark.range(300).selectExpr("'n' namespace", "concat('p', id) pod", "map('app', 'x', 'user', string(id)) labels", "map('app', 'x', 'user', string(id)) selector")
    matched = endpoints.select_pods(df, df)
    assert matched.count() == 300
    matched.collect()
    probe = [r["probe"]["key"] for r in endpoints.select_probes(df, df).collect()]
    assert probe == ["user"] * 300


def ask(spark, *times, selector=None):
    df = spark.createDataFrame([(i, "n", selector or {"app": "x"}, float(t)) for i, t in enumerate(times)],
                               "seq bigint, namespace string, selector map<string,string>, sec double")
    return df.withColumn("ts", F.expr(at("sec"))).drop("sec")


def resolved(df):
    base = dt.datetime(2024, 1, 1)
    return [(r["pod"], None if r["ready_ts"] is None else (r["ready_ts"] - base).total_seconds()) for r in df.orderBy("seq").collect()]


@pytest.mark.parametrize("width", [10**9, 2])
def test_request_finds_the_next_ready_pod(spark, width):
    snaps = pods(spark, ("a", 1000, [True]), ("a", 1100, [False]), ("b", 1050, [True]), ("b", 1200, [False]), ("c", 3000, [True], {"labels": {"app": "y"}}))
    reqs = ask(spark, 700, 699.999999, 1000, 1060, 1150, 1200, 5000)
    got = resolved(endpoints.resolve_endpoint(reqs, snaps, slice_width=width))
    assert got == [("a", 1000.0), (None, None), ("a", 1000.0), ("a", 1060.0), ("b", 1150.0), (None, None), (None, None)]


def test_pod_that_stays_ready_serves_later_requests(spark):
    got = resolved(endpoints.resolve_endpoint(ask(spark, 10, 99999, selector={}), pods(spark, ("a", 5, [True]))))
    assert got == [("a", 10.0), ("a", 99999.0)]
    none = resolved(endpoints.resolve_endpoint(ask(spark, 10, selector={"no": "pod"}), pods(spark, ("a", 5, [True]))))
    assert none == [(None, None)]


def test_wake_up_needs_the_same_object(spark):
    """The object without a namespace lives in `prod`; until an event names that, idle checks look in `default`."""
    reg = registry(spark, a=("scale", {"name": "o"}))
    res = live(spark, ("Deployment", "prod", "o", 3))
    ev = routed(spark, [("a", 19800, {"namespace": "prod"}), ("a", 30600, {"namespace": "prod"})])
    spans = runs(spark, ("a", 0, 36000, 3600))
    zero = actions.plan_scale_zero(state.idle_gaps(ev, spans, HORIZON), ev, reg, res).orderBy("fire_ts").collect()
    assert [(r["target_namespace"], r["action"]) for r in zero] == [("default", "none")] * 5 + [("prod", "patch_zero")] * 2 + [("prod", "patch_zero")]
    up = actions.plan_scale_up(actions.plan_actions(ev, reg), res, spans).orderBy("seq").collect()
    assert [r["action"] for r in up] == ["none", "patch"]


def test_ties_are_decided_alike(spark):
    """Messages of one instant and number: namespace and first event follow the same order."""
    reg = registry(spark, a=("create", {"name": "o"}))
    ev = routed(spark, [("a", 5, {"namespace": "y"}), ("a", 5, {"namespace": "x"})])
    ev = ev.withColumn("source", F.when(F.col("namespace") == "x", "t/1").otherwise("t/2")).withColumn("seq", F.lit(1).cast("bigint"))
    got = actions.resolve_namespace(actions.plan_actions(ev, reg)).collect()
    assert {r["target_namespace"] for r in got} == {"x"}


def test_endpoint_does_not_know_the_future(spark):
    """At 50 both are ready; that p2 will stay ready longer is not known yet. A removed pod serves no more."""
    snaps = pods(spark, ("p1", 10, [True]), ("p1", 20, [True]), ("p2", 30, [True], {"ip": ""}), ("p1", 60, [False]), ("p2", 90, [True], {"ip": ""}))
    snaps = snaps.withColumn("op", F.when(F.col("seq") == 4, "DELETE").otherwise("UPDATE"))
    got = endpoints.resolve_endpoint(ask(spark, 50, 70, 95), snaps)
    assert resolved(got) == [("p1", 50.0), ("p2", 70.0), (None, None)]
    assert [r["no_address"] for r in got.orderBy("seq").collect()] == [False, True, False]


def test_facts_of_generations_do_not_shuffle_events(spark):
    reg = registry(spark, a=("scale", {}), b=("delete", {}))
    ev = routed(spark, [("a", 2, {"namespace": "y"}), ("a", 1, {"namespace": "z"}), ("a", 1, {"namespace": "x"}), ("b", 1), ("b", 9)])
    plan = actions.plan_actions(ev, reg)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = actions.resolve_namespace(plan)
        shown = found._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the lookup of objects is the only join that may shuffle events; the copies of it lie below the aggregates
    assert shown.lstrip().splitlines()[1].lstrip(" +-").startswith("BroadcastHashJoin")
    assert {(r["seq"], r["target_namespace"]) for r in found.collect()} == {(0, "z"), (1, "z"), (2, "z"), (3, "default"), (4, "default")}


def test_first_event_without_time_is_first(spark):
    reg = registry(spark, a=("create", {}))
    ev = routed(spark, [("a", 2, {"namespace": "y"}), ("a", 1, {"namespace": "x"})])
    ev = ev.withColumn("ts", F.when(F.col("seq") > 0, F.col("ts")))
    got = actions.resolve_namespace(actions.plan_actions(ev, reg)).collect()
    assert {r["target_namespace"] for r in got} == {"y"}

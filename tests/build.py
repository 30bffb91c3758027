"""Literal sensors and events for tests."""

from __future__ import annotations

import json

SENSOR = (
    "sensor_key string, namespace string, name string, labels map<string,string>,"
    " trigger struct<type:string,meta:map<string,string>>,"
    " actor struct<operation:string,manifest:string,has_template:boolean,has_k8s:boolean,has_http:boolean>,"
    " target struct<type:string,meta:map<string,string>>,"
    " status struct<type:string,status:string,eventId:string,triggerId:string>,"
    " finalizers array<string>, deletion_ts timestamp, created_seq bigint"
)


def manifest(kind="Deployment", namespace="", name="obj", replicas=None, labels=None, api="apps/v1", containers=()):
    spec = {"selector": {"matchLabels": {"app": "x"}}}
    if replicas is not None:
        spec["replicas"] = replicas
    pods = [{"name": c} for c in containers]
    if kind == "Job":
        spec["template"] = {"spec": {"containers": pods}}
    elif pods:
        spec["containers"] = pods
    meta = {"name": name, "labels": labels or {}} | ({"namespace": namespace} if namespace else {})
    return json.dumps({"apiVersion": api, "kind": kind, "metadata": meta, "spec": spec})


def sensor(name, kind, meta, seq=1, operation="create", body=None, labels=None, target=None, status=None, finalizers=(), gone=None, **actor):
    has = {"has_template": True, "has_k8s": True, "has_http": False} | actor
    return (
        f"ns/{name}", "ns", name, labels or {}, (kind, meta),
        (operation, manifest() if body is None else body or None, has["has_template"], has["has_k8s"], has["has_http"]),
        target or ("events", {}), status, list(finalizers), gone, seq,
    )


def sensors(spark, *rows):
    return spark.createDataFrame(list(rows), SENSOR)


def routed(spark, rows, base="2024-01-01"):
    """Events (sensor, seconds after base, overrides) of generation 1."""
    fields = "family string, seq bigint, sec double, namespace string, source string, type string, version string, data string, uuid string, sensor_key string, generation bigint"
    data = []
    for i, (key, sec, *more) in enumerate(rows):
        o = {"namespace": "", "uuid": "", "generation": 1} | (more[0] if more else {})
        data.append(("f", i, float(sec), o["namespace"], "s", "t", "v", "d", o["uuid"], f"ns/{key}", o["generation"]))
    df = spark.createDataFrame(data, fields)
    return df.selectExpr(
        "family", "seq", f"timestamp'{base}' + make_dt_interval(0, 0, 0, cast(sec as decimal(18,6))) ts",
        "namespace", "source", "type", "version", "data", "uuid", "sensor_key", "generation",
    )


def runs(spark, *rows, base="2024-01-01"):
    """Generations (sensor, start s, end s or None, idle s)."""
    df = spark.createDataFrame([(f"ns/{k}", 1, float(a), None if b is None else float(b), d) for k, a, b, d in rows],
                               "sensor_key string, generation bigint, a double, b double, idle_s bigint")

    def at(c):
        return f"timestamp'{base}' + make_dt_interval(0, 0, 0, cast({c} as decimal(18,6)))"

    return df.selectExpr("sensor_key", "generation", f"{at('a')} valid_from", f"{at('b')} valid_to", "idle_s")

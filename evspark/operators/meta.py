"""Typed trigger and target options out of string maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.functions.columns import option, strict_int, text

# Trigger types a sensor may use and the option names of each.
STRING_OPTIONS = {
    "k8s_events": ["kind", "type", "apiVersion", "namespace"],
    "cloud_events": ["source", "type", "version"],
    "kafka": ["topic", "consumerGroup", "group", "saslType", "username", "password", "version"],
    "redis": ["addr", "username", "password", "channel"],
    "mqtt": ["uri", "topic", "username", "password"],
    "cron": ["cron"],
    "k8s_http": ["suffix"],
}
TARGET_OPTIONS = ["namespace", "apiVersion", "kind", "type", "message", "reason"]
HTTP_TARGET_OPTIONS = ["url", "method"]
DEFAULT_OFFSET_POLICY = "latest"
DEFAULT_PING_TIMEOUT_S = 1


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def _strings(meta: str, names: list[str]) -> list[Column]:
    return [text(option(meta, n)).alias(_snake(n)) for n in names]


def header_pairs(meta: str) -> Column:
    """``headers`` option ``k=v,k2=v2`` as an array of (name, value)."""
    pairs = F.filter(F.split(text(option(meta, "headers")), ","), lambda p: F.contains(p, F.lit("=")))
    return F.transform(
        pairs,
        lambda p: F.struct(
            F.trim(F.substring_index(p, "=", 1)).alias("name"),
            F.substr(p, F.instr(p, "=") + 1).alias("value"),
        ),
    )


def header_map(meta: str) -> Column:
    """``headers`` option as a map; the last of two equal names wins."""
    return F.aggregate(
        header_pairs(meta),
        F.create_map().cast("map<string,string>"),
        lambda acc, p: F.map_concat(F.map_filter(acc, lambda k, _: k != p["name"]), F.create_map(p["name"], p["value"])),
    )


def host_list(meta: str) -> Column:
    hosts = option(meta, "hosts")
    return F.when(hosts.isNotNull(), F.split(hosts, ",")).otherwise(F.array().cast("array<string>"))


def options(meta: str, kind: str) -> Column:
    """Typed options of one trigger type as a struct."""
    cols = _strings(meta, STRING_OPTIONS[kind])
    if kind == "kafka":
        cols += [
            F.coalesce(F.split(option(meta, "servers"), ","), F.array().cast("array<string>")).alias("servers"),
            F.coalesce(option(meta, "offsetResetPolicy"), F.lit(DEFAULT_OFFSET_POLICY)).alias("offset_reset_policy"),
        ]
    elif kind == "redis":
        db = option(meta, "db")
        cols += [F.when(db.isNull(), F.lit(0).cast("bigint")).otherwise(strict_int(db)).alias("db")]
    elif kind == "mqtt":
        ping = strict_int(option(meta, "pingTimeoutSecond"), "int")
        cols += [F.coalesce(F.nullif(ping, F.lit(0)), F.lit(DEFAULT_PING_TIMEOUT_S)).alias("ping_timeout_second")]
    elif kind == "k8s_http":
        cols += [host_list(meta).alias("hosts"), header_pairs(meta).alias("headers")]
    return F.struct(*cols)


def parse_meta(sensors: DataFrame) -> DataFrame:
    """One struct column per trigger type, null for sensors of another type, and the target's."""
    meta, kind = "trigger.meta", F.col("trigger.type")
    target = "target.meta"
    return sensors.withColumns(
        {f"{k}_options": F.when(kind == k, options(meta, k)) for k in STRING_OPTIONS}
        | {
            "events_target": F.when(F.col("target.type") == "events", F.struct(*_strings(target, TARGET_OPTIONS))),
            "http_target": F.when(
                F.col("target.type") == "http",
                F.struct(*_strings(target, HTTP_TARGET_OPTIONS), header_map(target).alias("headers")),
            ),
        }
    )

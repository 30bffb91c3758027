"""Validation report: the first problem of each sensor in checking order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.functions.columns import option, strict_int, text
from evspark.operators.manifest import manifest
from evspark.operators.meta import STRING_OPTIONS
from evspark.operators.state import idle_error
from evspark.settings import DEFAULTS, Settings
from evspark.sources.cron import cron_valid
from evspark.sources.feeds import KAFKA_POLICIES

# What an HTTP-triggered sensor may operate on.
HTTP_OPERATIONS = ("scale", "create")
SELECTOR_KINDS = ("StatefulSet", "Deployment")
TARGET_TYPES = ("http", "events")
# Broker versions: four numbers when the first is 0, otherwise three.
KAFKA_VERSION = r"^(0\.[0-9]+\.[0-9]+\.[0-9]+|[1-9][0-9]*\.[0-9]+\.[0-9]+)$"


def _first(*checks: tuple[Column, str]) -> Column:
    """Code of the first check that holds; null when none does."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for bad, code in checks])


def trigger_error() -> Column:
    kind, meta = F.col("trigger.type"), "trigger.meta"

    def opt(name: str) -> Column:
        return option(meta, name)

    actor, obj = F.col("actor"), F.col("_obj")
    by_type = {
        "mqtt": _first(
            (opt("pingTimeoutSecond").isNotNull(), "mqtt.ping_timeout_not_a_number"),
            ((text(opt("uri")) == "") | (text(opt("username")) == "") | (text(opt("password")) == ""), "mqtt.credentials_missing"),
        ),
        "cron": _first(
            (text(opt("cron")) == "", "cron.missing"),
            (~cron_valid("_cron"), "cron.not_valid"),
        ),
        "redis": _first((opt("db").isNotNull() & strict_int(opt("db")).isNull(), "redis.db_not_a_number")),
        "kafka": _first(
            (~opt("offsetResetPolicy").isin(*KAFKA_POLICIES), "kafka.offset_policy_unknown"),
            (~opt("version").rlike(KAFKA_VERSION), "kafka.version_not_valid"),
            (opt("allowIdleConsumers").isNotNull(), "kafka.allow_idle_not_a_boolean"),
        ),
        "k8s_http": _first(
            (~actor["has_template"] | ~actor["has_k8s"] | actor["manifest"].isNull(), "http.resource_missing"),
            (~actor["operation"].isin(*HTTP_OPERATIONS), "http.operation_not_supported"),
            (obj.isNull(), "http.manifest_not_valid"),
            (~obj["kind"].isin("Pod", *SELECTOR_KINDS), "http.kind_not_supported"),
            (obj["kind"].isin(*SELECTOR_KINDS) & obj["match_labels"].isNull(), "http.selector_missing"),
        ),
    }
    error = F.lit(None).cast("string")
    for name, check in by_type.items():
        error = F.when(kind == name, check).otherwise(error)
    return (
        F.when(F.coalesce(F.size(F.col(meta)), F.lit(0)) <= 0, F.lit("trigger.meta_missing"))
        .when(kind.isin(*STRING_OPTIONS), error)
        .otherwise(F.lit("trigger.type_not_supported"))
    )


def actor_error() -> Column:
    actor, obj = F.col("actor"), F.col("_obj")
    return _first(
        (actor.isNull() | ~actor["has_template"], "actor.template_missing"),
        (actor["has_k8s"] & actor["manifest"].isNull(), "actor.source_missing"),
        (actor["has_k8s"] & obj.isNull(), "actor.manifest_not_valid"),
        (~actor["has_k8s"] & actor["has_http"], "actor.http_not_supported"),
        (~actor["has_k8s"], "actor.template_empty"),
    )


def target_error() -> Column:
    has_target = F.coalesce(F.size("target.meta"), F.lit(0)) > 0
    return _first((has_target & ~F.col("target.type").isin(*TARGET_TYPES), "target.type_not_supported"))


def validate_sensors(sensors: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``valid`` and ``error``; triggers are checked before actors, targets and idle periods."""
    return (
        sensors.withColumns({"_obj": manifest(F.col("actor.manifest")), "_cron": option("trigger.meta", "cron")})
        .withColumn("error", F.coalesce(trigger_error(), actor_error(), target_error(), idle_error(settings)))
        .withColumn("valid", F.col("error").isNull())
        .drop("_obj", "_cron")
    )


def valid_sensors(sensors: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return validate_sensors(sensors, settings).where("valid").drop("valid", "error")

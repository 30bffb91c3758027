"""Reconciliation of sensor metadata and the readiness test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.settings import DEFAULTS


def is_ready(status: Column | None = None) -> Column:
    """True when the judgment has both ids and status ``True``; no judgment is not ready."""
    s = F.col("status") if status is None else status
    ready = (s["eventId"] != "") & (s["triggerId"] != "") & (s["status"] == "True")
    return F.coalesce(ready, F.lit(False))


def reconcile(sensors: DataFrame, finalizer: str = DEFAULTS.finalizer, deterministic: bool = True) -> DataFrame:
    """Live sensors get the finalizer and an event id, deleted ones lose the finalizer."""
    live = F.col("deletion_ts").isNull()
    new_id = F.md5(F.concat("sensor_key", F.lit("#event"))) if deterministic else F.uuid()
    own = F.array(F.lit(finalizer))
    held = F.coalesce("finalizers", F.array().cast("array<string>"))
    s = F.col("status")
    event_id = F.coalesce(F.nullif(s["eventId"], F.lit("")), new_id)
    adopted = F.when(
        s.isNull(),
        F.struct(
            F.lit("").alias("type"), F.lit("").alias("status"), new_id.alias("eventId"), F.lit("").alias("triggerId")
        ),
    ).otherwise(s.withField("eventId", event_id))
    return sensors.withColumns(
        {
            "finalizers": F.when(
                live, F.when(F.array_contains(held, finalizer), held).otherwise(F.concat(held, own))
            ).otherwise(F.array_remove(held, finalizer)),
            "status": F.when(live, adopted).otherwise(s),
        }
    )

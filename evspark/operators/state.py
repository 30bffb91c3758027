"""Per-sensor state: counts, last event, idleness and activity sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.functions.columns import ceil_div, int_div, micros, strict_int
from evspark.functions.ordered import running_sum
from evspark.functions.ranged import Ordered, in_order
from evspark.operators.registry import ticks_between
from evspark.settings import DEFAULTS, Settings
from evspark.sources.envelope import ORDER

RUN = ["sensor_key", "generation"]


def sensor_state(routed: DataFrame, intervals: DataFrame) -> DataFrame:
    """Event count and last event per generation; the last event starts as the start time."""
    seen = routed.groupBy(*RUN).agg(F.count("*").alias("n_events"), F.max("ts").alias("last_ts"))
    return intervals.select(*RUN, "valid_from").join(seen, RUN, "left").select(
        *RUN,
        F.coalesce("n_events", F.lit(0)).alias("n_events"),
        F.coalesce("last_ts", "valid_from").alias("last_ts"),
    )


def running_count(routed: DataFrame | Ordered, slice_width: int | None = None) -> DataFrame:
    """The count a sensor has after each event; rows of ``registry.routed_in_order`` are counted where they lie."""
    one = running_sum(F.lit(1).cast("bigint"))
    if isinstance(routed, DataFrame):
        return in_order(routed, RUN, ORDER, slice_width).scan(event_count=one).rows()
    return routed.by([c for c in ORDER if c in routed.df.columns]).scan(["generation"], event_count=one).rows()


def idle_config(sensors: DataFrame, settings: Settings = DEFAULTS, strict: bool = False) -> DataFrame:
    """Idle period in seconds per sensor.

    The enable label counts with any value unless ``strict``. A period that is absent, zero or
    not an integer becomes the default; a negative one, and one above ``settings.idle_longest_s``, is an
    error and gets no period.
    """
    enabled, asked = _idle_labels(settings, strict)
    error = idle_error(settings, strict)
    period = (
        F.when(~enabled, F.lit(settings.idle_disabled_s))
        .when(error.isNull() & (asked == 0), F.lit(settings.idle_default_s))
        .when(error.isNull(), asked)
    ).cast("bigint")
    return sensors.select("sensor_key", enabled.alias("idle_enabled"), period.alias("idle_s"), error.alias("idle_error"))


def _idle_labels(settings: Settings, strict: bool) -> tuple[Column, Column]:
    """Whether idle checks are enabled, and the seconds asked for (0 if none)."""
    labels = F.coalesce("labels", F.create_map().cast("map<string,string>"))
    value = F.try_element_at(labels, F.lit(settings.idle_enable_label))
    enabled = F.coalesce(value == "true", F.lit(False)) if strict else F.map_contains_key(labels, settings.idle_enable_label)
    return enabled, F.coalesce(strict_int(F.try_element_at(labels, F.lit(settings.idle_time_label))), F.lit(0))


def idle_error(settings: Settings = DEFAULTS, strict: bool = False) -> Column:
    """Code of an idle period that cannot be used; null if there is none or checks are not enabled."""
    enabled, asked = _idle_labels(settings, strict)
    return F.when(enabled & (asked < 0), F.lit("idle.negative")).when(enabled & (asked > settings.idle_longest_s), F.lit("idle.too_long"))


def with_idle(intervals: DataFrame, sensors: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Generations with their idle period; sensors with an idle error have no checks."""
    periods = idle_config(sensors, settings).where("idle_error is null").select("sensor_key", "idle_s")
    return intervals.join(periods, "sensor_key").select(*RUN, "valid_from", "valid_to", "idle_s")


def busy_ticks(routed: DataFrame, runs: DataFrame, horizon: str) -> DataFrame:
    """Idle checks that an event keeps from firing, plus check 0 for each start.

    Checks are at A + k*D. An event at e blocks those in [e, e + D), which is exactly
    k = ceil((e - A) / D), so events collapse to distinct checks before any window runs.
    """
    clock = runs.select(
        *RUN,
        micros(F.col("valid_from")).alias("a"),
        (F.col("idle_s") * 1_000_000).alias("d"),
        micros(F.least(F.coalesce("valid_to", F.lit(horizon).cast("timestamp")), F.lit(horizon).cast("timestamp"))).alias("h"),
    ).withColumn("last_k", int_div(F.col("h") - F.col("a"), F.col("d")))
    clock = clock.where("h >= a").select(*RUN, "a", "d", "last_k")
    offset = micros(F.col("ts")) - F.col("a")
    blocked = (
        routed.select(*RUN, "ts").join(clock, RUN)
        .where(offset >= 0)
        .select(*RUN, "a", "d", "last_k", ceil_div(offset, F.col("d")).alias("k"))
    )
    seeds = clock.select(*RUN, "a", "d", "last_k", F.lit(0).cast("bigint").alias("k"))
    return blocked.unionByName(seeds).where("k <= last_k").distinct()


def idle_gaps(routed: DataFrame, runs: DataFrame, horizon: str) -> DataFrame:
    """Runs of consecutive checks ``lo`` to ``hi`` that fire; check k is at a + k * d microseconds.

    ``runs`` comes from :func:`with_idle`. The window sees distinct checks only, at most
    one per period of the sensor, however many events there are.
    """
    w = Window.partitionBy(*RUN).orderBy("k")
    return (
        busy_ticks(routed, runs, horizon)
        .withColumn("hi", F.coalesce(F.lead("k").over(w) - 1, F.col("last_k")))
        .withColumn("lo", F.col("k") + 1)
        .where("lo <= hi")
        .select(*RUN, "a", "d", "lo", "hi")
    )


def fire_time(check: str) -> Column:
    return F.timestamp_micros(F.col("a") + F.col(check) * F.col("d"))


def idle_firings(routed: DataFrame, runs: DataFrame, horizon: str) -> DataFrame:
    """Idle checks that fire, up to the end of the generation or ``horizon``."""
    return ticks_between(idle_gaps(routed, runs, horizon), "lo", "hi").select(
        *RUN, fire_time("k").alias("fire_ts"), (F.col("k") == F.col("lo")).alias("first_in_gap")
    )


def activity_sessions(routed: DataFrame, runs: DataFrame) -> DataFrame:
    """Spans in which a sensor is not idle, with event counts.

    Two events belong together when at most one period apart. Events of one period-wide
    bucket always do, so buckets are aggregated first and only they are windowed.
    """
    d = F.col("d")
    us = micros(F.col("ts"))
    periods = runs.select(*RUN, (F.col("idle_s") * 1_000_000).alias("d"))
    buckets = (
        routed.select(*RUN, "ts").join(periods, RUN)
        .groupBy(*RUN, "d", int_div(us - F.pmod(us, d), d).alias("b"))
        .agg(F.min(us).alias("first"), F.max(us).alias("last"), F.count("*").alias("n"))
    )
    w = Window.partitionBy(*RUN).orderBy("b")
    opens = F.coalesce(F.col("first") - F.lag("last").over(w) > d, F.lit(True))
    return (
        buckets.withColumn("opens", opens.cast("int"))
        .withColumn("session", F.sum("opens").over(w))
        .groupBy(*RUN, "d", "session")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n_events"))
        .select(
            *RUN,
            F.timestamp_micros("first").alias("session_start"),
            F.timestamp_micros(F.col("last") + d).alias("session_end"),
            "n_events",
        )
    )

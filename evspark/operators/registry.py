"""Sensor registry: change feed, generations, listing and the active roster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.functions.columns import ceil_div, int_div, micros, object_fingerprint
from evspark.functions.ordered import following_row, last_value, previous_row, running_sum
from evspark.functions.ranged import Ordered, in_order
from evspark.settings import DEFAULTS

KEY = ["sensor_key"]
ORDER = ["ts", "seq"]


def registry_current(changes: DataFrame) -> DataFrame:
    """Latest state per sensor; deleted sensors are gone."""
    rest = [c for c in changes.columns if c not in KEY]
    latest = F.max_by(F.struct(*rest), F.struct(*ORDER))
    return (
        changes.groupBy(*KEY).agg(latest.alias("r")).select(*KEY, "r.*").where(F.col("op") != "DELETE").select(*changes.columns)
    )


def drop_noop_updates(changes: DataFrame, spec: Column | None = None, slice_width: int | None = None) -> DataFrame:
    """Without updates that repeat the state the sensor already has.

    The state is the whole object, that is all columns but key, operation, time and sequence; ``spec`` is another
    fingerprint to compare instead.
    """
    return _real_changes(changes, spec, slice_width).rows().select(*changes.columns)


def _real_changes(changes: DataFrame, spec: Column | None, slice_width: int | None) -> Ordered:
    whole = [c for c in changes.columns if c not in (*KEY, *ORDER, "op")]
    marked = changes.withColumn("_fp", object_fingerprint(changes, whole) if spec is None else spec)
    seen = in_order(marked, KEY, ORDER, slice_width).scan(_before=previous_row(F.struct("op", "_fp")))
    same = (F.col("op") == "UPDATE") & (F.col("_before.op") != "DELETE") & F.col("_fp").eqNullSafe(F.col("_before._fp"))
    return seen.where(~F.coalesce(same, F.lit(False)))


def registry_intervals(changes: DataFrame, spec: Column | None = None, slice_width: int | None = None) -> DataFrame:
    """One row per generation: a real change ends one and starts the next, a delete ends it.

    The changes are stored in order once; both scans run on that table.
    """
    starts = (F.col("op") != "DELETE").cast("bigint")
    spans = _real_changes(changes, spec, slice_width).scan(generation=running_sum(starts), _next=following_row(F.struct("ts"))).rows()
    return spans.where(F.col("op") != "DELETE").select(
        *[c for c in changes.columns if c not in ("op", "ts")],
        "generation", F.col("ts").alias("valid_from"), F.col("_next.ts").alias("valid_to"),
    )


def route_asof(events: DataFrame, intervals: DataFrame, slice_width: int | None = None) -> DataFrame:
    """Events with the generation of their sensor at event time; others are dropped.

    Backward as-of join by one scan over events and generation starts, so that a sensor
    with many events and many generations never pairs them.
    """
    return routed_in_order(events, intervals, slice_width).rows()


def routed_in_order(events: DataFrame, intervals: DataFrame, slice_width: int | None = None) -> Ordered:
    """The rows of :func:`route_asof` as they are placed, for more scans in the same order."""
    span = F.struct("generation", "valid_from", "valid_to")
    starts = intervals.select(
        *KEY, F.col("valid_from").alias("ts"), F.lit(0).alias("_side"), F.col("generation").alias("seq"), span.alias("_span")
    )
    both = events.withColumn("_side", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    found = in_order(both, KEY, ["ts", "_side", "seq"], slice_width).scan(_at=last_value(F.col("_span")))
    alive = F.col("_at.valid_to").isNull() | (F.col("ts") < F.col("_at.valid_to"))
    return found.where((F.col("_side") == 1) & F.col("_at").isNotNull() & alive).select(
        *events.columns, "_at.generation", "_at.valid_from", "_at.valid_to"
    )


def label_matches(labels: Column, requirements: list[tuple]) -> Column:
    """All requirements ``(key, operator[, value or values])`` hold.

    Operators: ``=``, ``!=``, ``in``, ``notin``, ``exists``, ``!exists``. The negative ones
    also hold when the key is absent.
    """
    result = F.lit(True)
    for key, op, *rest in requirements:
        has, value = F.map_contains_key(labels, key), F.try_element_at(labels, F.lit(key))
        values = list(rest[0]) if rest and not isinstance(rest[0], str) else list(rest)
        if op in ("=", "in"):
            test = has & value.isin(values)
        elif op in ("!=", "notin"):
            test = ~has | ~value.isin(values)
        elif op == "exists":
            test = has
        elif op == "!exists":
            test = ~has
        else:
            raise ValueError(f"unknown selector operator {op!r}")
        result = result & F.coalesce(test, F.lit(False))
    return result


def list_sensors(sensors: DataFrame, namespace: str | None = None, selector: list[tuple] = ()) -> DataFrame:
    picked = sensors.where(F.col("namespace") == namespace) if namespace else sensors
    return picked.where(label_matches(F.col("labels"), list(selector)))


def get_sensor(sensors: DataFrame, namespace: str, name: str) -> DataFrame:
    return sensors.where(F.col("sensor_key") == f"{namespace}/{name}")


def active_roster(intervals: DataFrame, start: str, end: str, step_s: int = DEFAULTS.roster_step_s) -> DataFrame:
    """Number of sensors alive at each report time ``start + k * step`` up to ``end``.

    Starts and ends become +1 and -1 at the first report at or after them. The running sum
    is taken per day and shifted by the sum of the days before, so its size depends on
    the length of the period only.
    """
    lo, hi, step = micros(F.lit(start).cast("timestamp")), micros(F.lit(end).cast("timestamp")), F.lit(step_s * 1_000_000)
    per_day = F.lit(max(86400 // step_s, 1))

    def tick(ts: Column) -> Column:
        return ceil_div(F.greatest(micros(ts) - lo, F.lit(0)), step)

    begins = intervals.select(tick(F.col("valid_from")).alias("k"), F.lit(1).alias("d"))
    ends = intervals.where(F.col("valid_to").isNotNull()).select(tick(F.col("valid_to")).alias("k"), F.lit(-1).alias("d"))
    last = int_div(hi - lo, step)
    deltas = begins.unionByName(ends).where(F.col("k") <= last).groupBy("k").agg(F.sum("d").alias("d"))

    spark = intervals.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(0).cast("bigint"), int_div(last, per_day))).alias("day"))
    grid = days.repartition("day").select(
        "day",
        F.explode(F.sequence(F.col("day") * per_day, F.least((F.col("day") + 1) * per_day - 1, last))).alias("k"),
    )
    here = grid.join(deltas, "k", "left").withColumn(
        "here", F.sum(F.coalesce("d", F.lit(0))).over(Window.partitionBy("day").orderBy("k"))
    )
    # one row per day of the period
    day_sums = deltas.groupBy(int_div(F.col("k"), per_day).alias("day")).agg(F.sum("d").alias("s"))
    earlier = (
        days.join(day_sums, "day", "left")
        .withColumn("all", F.lit(1))
        .withColumn(
            "before",
            F.sum("s").over(Window.partitionBy("all").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select("day", F.coalesce("before", F.lit(0)).alias("before"))
    )
    return here.join(earlier, "day").select(
        F.timestamp_micros(lo + F.col("k") * step).alias("ts"), (F.col("here") + F.col("before")).alias("active")
    )


def active_roster_keys(intervals: DataFrame, start: str, end: str, step_s: int = DEFAULTS.roster_step_s) -> DataFrame:
    """One row per report time and sensor alive then."""
    lo, hi, step = micros(F.lit(start).cast("timestamp")), micros(F.lit(end).cast("timestamp")), F.lit(step_s * 1_000_000)
    first = ceil_div(F.greatest(micros(F.col("valid_from")) - lo, F.lit(0)), step)
    last = int_div(hi - lo, step)
    ended = ceil_div(F.greatest(micros(F.col("valid_to")) - lo, F.lit(0)), step) - 1
    stop = F.when(F.col("valid_to").isNull(), last).otherwise(F.least(ended, last))
    spans = intervals.select(*KEY, first.alias("a"), stop.alias("b")).where("a <= b")
    return ticks_between(spans, "a", "b").select(F.timestamp_micros(lo + F.col("k") * step).alias("ts"), *KEY)


def ticks_between(spans: DataFrame, lo: str, hi: str, chunk: int = 4096) -> DataFrame:
    """Rows for k = lo..hi, expanded in two steps so that no array exceeds the larger of chunk and its count."""
    return (
        spans.withColumn("_c", F.explode(F.sequence(F.col(lo), F.col(hi), F.lit(chunk).cast("bigint"))))
        .withColumn("k", F.explode(F.sequence(F.col("_c"), F.least(F.col("_c") + chunk - 1, F.col(hi)))))
        .drop("_c")
    )

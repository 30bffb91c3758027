"""Ordered scans per key that survive a key holding a large share of all rows.

A plain window sorts every row of one key in one task. Here each key is cut into slices of its order: all rows
whose first order column falls in the same ``width`` (seconds of a timestamp, units of a number). The window runs per
(key, slice), one summary row per slice carries the state across slices, and both are joined again. The plan is
the same at any size, and building it starts no job. ``width`` is the only bound: a task holds the rows
of one key in one slice, and one task sees one summary row per slice of a key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from evspark.functions.columns import int_div

SLICE = 86400
"""Default width: a day of a timestamp."""


@dataclass(frozen=True)
class Scan:
    """One output column: its form inside a slice and its carry between slices.

    A ``backward`` scan gets windows in descending order: a frame that grows row by row is
    linear in Spark, one that shrinks towards its end is evaluated anew for every row.
    """

    local: Callable[[WindowSpec], Column]
    summary: Callable[[Column], Column]
    carry: Callable[[Column, WindowSpec], Column]
    merge: Callable[[Column, Column], Column]
    backward: bool = False


def _upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def last_value(value: Column) -> Scan:
    """Last non-null value at or before the row (backward as-of, carry forward)."""
    return Scan(
        local=lambda w: F.last(value, ignorenulls=True).over(_upto(w)),
        summary=lambda order: F.max_by(value, F.when(value.isNotNull(), order)),
        carry=lambda s, w: F.last(s, ignorenulls=True).over(_before(w)),
        merge=F.coalesce,
    )


def next_value(value: Column) -> Scan:
    """First non-null value at or after the row (forward as-of)."""
    return Scan(
        local=lambda w: F.last(value, ignorenulls=True).over(_upto(w)),
        summary=lambda order: F.min_by(value, F.when(value.isNotNull(), order)),
        carry=lambda s, w: F.last(s, ignorenulls=True).over(_before(w)),
        merge=F.coalesce,
        backward=True,
    )


def running_max(value: Column) -> Scan:
    return Scan(
        local=lambda w: F.max(value).over(_upto(w)),
        summary=lambda _: F.max(value),
        carry=lambda s, w: F.max(s).over(_before(w)),
        merge=F.greatest,
    )


def earlier_max(value: Column) -> Scan:
    """Largest value before the row."""
    return Scan(
        local=lambda w: F.max(value).over(_before(w)),
        summary=lambda _: F.max(value),
        carry=lambda s, w: F.max(s).over(_before(w)),
        merge=F.greatest,
    )


def running_sum(value: Column) -> Scan:
    return Scan(
        local=lambda w: F.sum(value).over(_upto(w)),
        summary=lambda _: F.sum(value),
        carry=lambda s, w: F.sum(s).over(_before(w)),
        merge=lambda here, earlier: here + F.coalesce(earlier, F.lit(0)),
    )


def previous_row(value: Column) -> Scan:
    """``value`` (a struct, so never null) of the row before."""
    return Scan(
        local=lambda w: F.lag(value).over(w),
        summary=lambda order: F.max_by(value, order),
        carry=lambda s, w: F.lag(s).over(w),
        merge=F.coalesce,
    )


def following_row(value: Column) -> Scan:
    """``value`` (a struct, so never null) of the row after."""
    return Scan(
        local=lambda w: F.lead(value).over(w),
        summary=lambda order: F.min_by(value, order),
        carry=lambda s, w: F.lead(s).over(w),
        merge=F.coalesce,
    )


def scan(df: DataFrame, keys: list[str], order: list[str], width: int = SLICE, **outputs: Scan) -> DataFrame:
    """Add ``outputs`` to ``df``, scanned per ``keys`` in ``order``.

    ``keys`` and ``order`` must be non-null and ``order`` should be unique within a key. Its first column is a
    timestamp or an integer.
    """
    if df.isStreaming:
        raise ValueError("ordered scans need a bounded table")
    sliced = df.withColumn("_slice", _slice(df, order[0], width))
    window = _windows([*keys, "_slice"], order)
    local = sliced.withColumns({f"_here_{n}": s.local(window[s.backward]) for n, s in outputs.items()})

    place = F.struct(*order)
    summary = sliced.groupBy(*keys, "_slice").agg(
        *[s.summary(place).alias(f"_sum_{n}") for n, s in outputs.items()]
    )
    across = _windows(keys, ["_slice"])
    carried = summary.select(
        *keys, "_slice",
        *[s.carry(F.col(f"_sum_{n}"), across[s.backward]).alias(f"_carry_{n}") for n, s in outputs.items()],
    )
    joined = local.join(carried, [*keys, "_slice"])
    merged = {n: s.merge(F.col(f"_here_{n}"), F.col(f"_carry_{n}")) for n, s in outputs.items()}
    return joined.withColumns(merged).select(*df.columns, *outputs)


def _slice(df: DataFrame, column: str, width: int) -> Column:
    """Number of the slice: whole widths below the value, rounded down for negative ones too."""
    value = F.col(column)
    if df.schema[column].dataType.typeName().startswith("timestamp"):
        value = F.unix_seconds(value.cast("timestamp"))
    # not floor(value / width): doubles would merge large numbers
    return int_div(value - F.pmod(value, F.lit(width).cast("bigint")), F.lit(width).cast("bigint"))


def _windows(keys: list[str], order: list[str]) -> dict[bool, WindowSpec]:
    by = Window.partitionBy(*keys)
    return {False: by.orderBy(*order), True: by.orderBy(*[F.desc(c) for c in order])}


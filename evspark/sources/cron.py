"""Cron schedules (second minute hour day-of-month month day-of-week) to tick events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.functions.columns import micros
from evspark.sources.envelope import envelope

# Field bounds and names of the six-field cron format; Sunday is 0.
FIELDS = ["second", "minute", "hour", "dom", "month", "dow"]
LOWEST = [0, 0, 0, 1, 1, 0]
HIGHEST = [59, 59, 23, 31, 12, 6]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DAYS = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]
TICK_SHIFT = 28


def _list(values: list) -> str:
    return f"array({', '.join(str(v) for v in values)})"


def _members(cron: str) -> str:
    """SQL: every field as its list members (lowest, highest, step, good, unrestricted).

    Parsing goes in short steps, each over the variable of the step before, so that the
    expression does not grow by substitution.
    """
    names = [f"'4{n}', {i + 1}" for i, n in enumerate(MONTHS)] + [f"'5{n}', {i}" for i, n in enumerate(DAYS)]

    def number(word: str) -> str:
        digits = f"if({word} rlike '^[+]?[0-9]+$', try_cast({word} as int), null)"
        return f"coalesce({digits}, try_element_at(map({', '.join(names)}), concat(m.i, lower({word}))))"

    def each(fields: str, body: str) -> str:
        return f"transform({fields}, f -> transform(f, m -> {body}))"

    words = f"split(trim(regexp_replace({cron}, '[ \\\\t]+', ' ')), ' ')"
    listed = (
        f"transform({words}, (w, i) -> transform(filter(split(w, ','), p -> p <> ''),"
        " p -> named_struct('i', i, 'parts', split(p, '/'))))"
    )
    ended = each(listed, "named_struct('i', m.i, 'parts', m.parts, 'ends', split(m.parts[0], '-'))")
    read = each(
        ended,
        "named_struct('i', m.i, 'star', m.ends[0] in ('*', '?'), 'one', size(m.ends) = 1, 'stepped', size(m.parts) = 2,"
        " 'shaped', size(m.parts) <= 2 and size(m.ends) <= 2,"
        f" 'first', {number('m.ends[0]')}, 'second', {number('get(m.ends, 1)')},"
        " 'by', if(size(m.parts) = 1, 1, if(get(m.parts, 1) rlike '^[+]?[0-9]+$', try_cast(get(m.parts, 1) as int), null)))",
    )
    ranged = each(
        read,
        "named_struct('i', m.i, 'star', m.star, 'shaped', m.shaped, 'by', m.by,"
        f" 'lo', if(m.star, get({_list(LOWEST)}, m.i), m.first),"
        f" 'hi', case when m.star or (m.one and m.stepped) then get({_list(HIGHEST)}, m.i)"
        " when m.one then m.first else m.second end)",
    )
    return each(
        ranged,
        "named_struct('lo', m.lo, 'hi', m.hi, 'by', m.by, 'any', m.star and m.by = 1,"
        f" 'good', coalesce(m.shaped and m.lo >= get({_list(LOWEST)}, m.i) and m.hi <= get({_list(HIGHEST)}, m.i)"
        " and m.lo <= m.hi and m.by > 0, false))",
    )


def cron_fields(cron: str) -> Column:
    """Array with one struct per field of a cron column: ``good``, ``any`` (unrestricted), ``values``."""
    values = "array_sort(array_distinct(flatten(transform(filter(f, m -> m.good), m -> sequence(m.lo, m.hi, m.by)))))"
    return F.expr(
        f"transform({_members(cron)}, f -> named_struct('good', forall(f, m -> m.good),"
        f" 'any', exists(f, m -> m.any), 'values', {values}))"
    )


def cron_valid(cron: str) -> Column:
    """True when a cron column has six fields of valid members."""
    fields = f"transform({_members(cron)}, f -> forall(f, m -> m.good))"
    return F.expr(f"coalesce(size({fields}) = {len(FIELDS)} and forall({fields}, g -> g), false)")


def cron_ticks(schedules: DataFrame, start: str, end: str) -> DataFrame:
    """Tick events of every schedule after ``start`` up to and including ``end``.

    ``schedules`` has ``sensor_key``, ``created_seq`` (unique) and ``cron``. Days are filtered before
    hours, minutes and seconds are expanded, and the (schedule, day) pairs are spread over
    the cluster, so that a dense schedule is not expanded by one task.
    """
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    day = F.col("day")
    in_dom = F.array_contains("dom.values", F.dayofmonth(day))
    in_dow = F.array_contains("dow.values", F.dayofweek(day) - 1)
    either = F.when(F.col("dom.any") | F.col("dow.any"), in_dom & in_dow).otherwise(in_dom | in_dow)
    fields = schedules.where(cron_valid("cron")).select(
        "sensor_key", "created_seq", F.explode(F.array(cron_fields("cron"))).alias("f")
    )
    days = (
        fields.select(
            "sensor_key", "created_seq", *[F.col("f")[i].alias(n) for i, n in enumerate(FIELDS)],
            F.explode(F.sequence(F.to_date(lo), F.to_date(hi))).alias("day"),
        )
        .where(F.array_contains("month.values", F.month(day)) & either)
        .select("sensor_key", "created_seq", "day", *[F.col(f"{n}.values").alias(n) for n in ("hour", "minute", "second")])
        .repartition("created_seq", "day")
    )
    ticks = (
        days.withColumn("h", F.explode("hour")).drop("hour")
        .withColumn("m", F.explode("minute")).drop("minute")
        .withColumn("s", F.explode("second")).drop("second")
        .withColumn("epoch_s", F.unix_date("day").cast("bigint") * 86400 + F.col("h") * 3600 + F.col("m") * 60 + F.col("s"))
        .withColumn("ts", F.timestamp_seconds("epoch_s"))
        .where((F.col("ts") > lo) & (F.col("ts") <= hi))
    )
    packed = F.shiftleft(F.col("epoch_s"), TICK_SHIFT) + F.col("created_seq")
    seq = F.when(F.col("created_seq") < 1 << TICK_SHIFT, packed).otherwise(F.raise_error(F.lit("created_seq too large for an event number")))
    return envelope(
        ticks, "cron", seq, F.col("ts"), ("sensor_key",),
        type=F.lit("cron"), data=(micros(F.col("ts")) * 1000).cast("string"),
    )

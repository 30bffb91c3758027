"""Streaming idle detector with the rule of ``operators.state.idle_firings``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from evspark.functions.columns import ceil_div, micros
from evspark.operators.state import RUN

OUTPUT = "sensor_key string, generation bigint, fire_ts timestamp, first_in_gap boolean"
NEVER = 2**62
STATE = "a bigint, d bigint, stop bigint, next_k bigint, quiet boolean, busy array<bigint>"


def idle_stream(routed: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Idle checks that fire once the watermark has passed them.

    ``routed`` is a stream with ``sensor_key``, ``generation``, ``ts``, ``valid_from``, ``valid_to`` (null while
    the generation lasts) and ``idle_s``. A generation is known from its first row on, so send
    one row per generation at its start (it counts as check 0 and blocks nothing).
    An event blocks exactly one check, so the events of a sensor are reduced to distinct numbers of checks before they are grouped: the
    group sees a row per check that was kept from firing, however many events there are. Checks still in doubt are those the watermark
    has not passed; only these are state, and a generation's state goes when the watermark has passed its end.
    """
    begin, period = micros(F.col("valid_from")), F.col("idle_s") * 1_000_000
    narrow = routed.select(
        *RUN, "ts",
        begin.alias("a"), period.alias("d"), F.coalesce(micros(F.col("valid_to")), F.lit(NEVER)).alias("stop"),
        # the one check that the row blocks; 0 for the start and anything before it
        F.when(micros(F.col("ts")) > begin, ceil_div(micros(F.col("ts")) - begin, period)).otherwise(0).alias("k"),
    ).where(micros(F.col("ts")) < F.col("stop"))

    def step(key, batches, state):
        import numpy as np
        import pandas as pd

        if state.exists:
            a, d, stop, next_k, quiet, busy = state.get
            busy = set(busy)
        else:
            a = d = stop = next_k = quiet = None
            busy = set()
        for pdf in batches:
            if not len(pdf):
                continue
            if a is None:
                a, d, stop = (int(pdf[c].iloc[0]) for c in ("a", "d", "stop"))
                next_k, quiet = 1, False
            stop = min(stop, int(pdf["stop"].min()))
            busy.update(int(k) for k in pdf["k"] if k >= next_k)
        if a is None:
            return

        passed = state.getCurrentWatermarkMs() * 1000
        # checks strictly before the watermark are settled: all their events have arrived
        end_k = min((passed - 1 - a) // d if passed > a else 0, (stop - a) // d)
        chunk = 65536
        while next_k <= end_k:
            ks = np.arange(next_k, min(next_k + chunk, end_k + 1), dtype="int64")
            hit = np.isin(ks, np.fromiter(busy, dtype="int64", count=len(busy)))
            before = np.concatenate(([quiet], ~hit[:-1]))
            fire = ~hit
            if fire.any():
                yield pd.DataFrame(
                    {
                        "sensor_key": key[0],
                        "generation": key[1],
                        "fire_ts": pd.to_datetime(a + ks[fire] * d, unit="us"),
                        "first_in_gap": ~before[fire],
                    }
                )
            quiet = bool(fire[-1])
            next_k = int(ks[-1]) + 1
            busy = {k for k in busy if k >= next_k}

        if passed > stop:
            # nothing can fire any more, and rows of this generation come too late from here on
            if state.exists:
                state.remove()
            return
        over = a + next_k * d > stop
        state.update((a, d, stop, next_k, quiet, [] if over else sorted(busy)))
        if stop < NEVER or not over:
            due_ms = (stop if over else a + next_k * d) // 1000 + 1
            state.setTimeoutTimestamp(max(due_ms, state.getCurrentWatermarkMs() + 1))

    return (
        narrow.withWatermark("ts", lateness)
        .dropDuplicatesWithinWatermark([*RUN, "k", "stop"])
        .groupBy(*RUN)
        .applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )

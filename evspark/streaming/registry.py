"""The changing registry on streams: changes without effect are dropped, and events meet the generation alive at their time.

Rows wait in the state of their sensor until the watermark has passed them, and are then taken in the order of time, so the order in
which batches bring them does not matter. A timer per sensor wakes it when its earliest row is due. Rows behind the watermark are
dropped by Spark and counted (:func:`late_rows`).

A sensor with a large share of all events is spread: events are dealt to ``salts`` states of their sensor, and each change goes to all of
them. State per sensor and salt is the change that counts now and the rows that still wait. These are packed by thousands into one entry of
the state, because each entry is converted on its way to the state store and back, which costs more than all else that is done with a row.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from evspark.functions.columns import micros, object_fingerprint
from evspark.operators.registry import KEY, ORDER

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE, EVENT = 0, 1
DELETE, UPDATE = "DELETE", "UPDATE"


PACKED = 1000
"""Most rows in one entry of the state."""


def _pack(rows: list[tuple]) -> list[tuple]:
    return [(pickle.dumps(rows[i : i + PACKED], pickle.HIGHEST_PROTOCOL),) for i in range(0, len(rows), PACKED)]


HELD = 20_000
"""Most new rows of a key that are held before they are packed, if its waiting rows lie by slices of time."""


class _InOrder(StatefulProcessor):
    """Hands the rows of a key to :meth:`take` in order, once the watermark has passed them.

    Rows that wait are read all at once. For keys with more rows than a worker's memory, ``slice_us`` has their state lie by slices of time of so many
    microseconds, of which one is read at a time.
    """

    waiting_schema: T.StructType
    current_schema: T.StructType
    slice_us: int | None = None

    def init(self, handle) -> None:
        self.handle = handle
        if self.slice_us is None:
            self.waiting = handle.getListState("waiting", "rows binary")
        else:
            self.slices = handle.getMapState("slices", "slice bigint, entry bigint", "rows binary")
            self.entries = handle.getValueState("entries", "n bigint")
        self.due = handle.getValueState("due", "ms bigint")
        self.current = handle.getValueState("current", self.current_schema)

    def close(self) -> None:
        pass

    def place(self, row: dict) -> tuple:
        raise NotImplementedError

    def take(self, key, current: tuple | None, row: dict) -> tuple[tuple | None, Row | None]:
        """The state behind a row, and what it emits; without a state nothing is kept."""
        raise NotImplementedError

    def _wake_at(self, ms: int | None) -> None:
        held = self.due.get()
        if held is not None and held[0] != ms:
            self.handle.deleteTimer(held[0])
        if ms is None:
            self.due.clear()
        elif held is None or held[0] != ms:
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = (tuple(_plain_value(r[c]) for c in self.waiting_schema.names) for r in rows)
        earliest = None
        while some := list(islice(new, None if self.slice_us is None else HELD)):
            first = min(r[0] for r in some)
            earliest = first if earliest is None else min(first, earliest)
            if self.slice_us is None:
                self.waiting.appendList(_pack(some))
            else:
                self._put(some)
        if earliest is not None:
            held = self.due.get()
            first = earliest // 1000 + 1
            self._wake_at(first if held is None else min(first, held[0]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        self.earliest = None
        yield from self.settle(key, self._passed_at_once(passed) if self.slice_us is None else self._passed_by_slice(passed), passed)
        wakes = [us for us in (self.earliest, self.next_due()) if us is not None]
        if wakes:
            self._wake_at(min(wakes) // 1000 + 1)

    def _in_order(self, rows: Iterator[tuple]) -> list[dict]:
        return sorted((dict(zip(self.waiting_schema.names, r, strict=True)) for r in rows), key=self.place)

    def _passed_at_once(self, passed: int) -> Iterator[dict]:
        """Rows that the watermark ``passed``, in order; the others stay, the first at ``earliest``."""
        rows = self._in_order(row for entry in self.waiting.get() for row in pickle.loads(entry[0]))
        settled = [r for r in rows if r["us"] < passed]
        rest = [tuple(r.values()) for r in rows[len(settled) :]]
        if rest:
            self.waiting.put(_pack(rest))
            self.earliest = rest[0][0]
        else:
            self.waiting.clear()
        yield from settled

    def _put(self, rows: list[tuple]) -> None:
        """Pack rows into new entries of their slices."""
        n = (self.entries.get() or (0,))[0]
        for at, some in groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0] // self.slice_us):
            for entry in _pack(list(some)):
                n += 1
                self.slices.updateValue((at, n), entry)
        self.entries.update((n,))

    def _passed_by_slice(self, passed: int) -> Iterator[dict]:
        """The same, one slice after the other."""
        for at, entries in groupby(sorted(tuple(k) for k in self.slices.keys()), key=lambda k: k[0]):
            entries = list(entries)
            rows = self._in_order(row for e in entries for row in pickle.loads(self.slices.getValue(e)[0]))
            if (at + 1) * self.slice_us <= passed:
                rest = []
            else:
                rest = [r for r in rows if r["us"] >= passed]
                rows = rows[: len(rows) - len(rest)]
            if rows:
                for e in entries:
                    self.slices.removeKey(e)
                if rest:
                    self._put([tuple(r.values()) for r in rest])
            yield from rows
            if rest:
                self.earliest = rest[0]["us"]
                return

    def settle(self, key, rows: Iterable[dict], passed: int) -> Iterator[Row]:
        """Take the rows that the watermark ``passed``; others may follow later."""
        held = self.current.get()
        current = None if held is None else tuple(held)
        for row in rows:
            current, out = self.take(key, current, row)
            if out is not None:
                yield out
        if current is not None:
            self.current.update(current)
        elif held is not None:
            self.current.clear()

    def next_due(self) -> int | None:
        """A time at which the key must wake without a row."""
        return None


def _plain_value(value):
    return tuple(map(_plain_value, value)) if isinstance(value, tuple) else value


def _same(before: tuple | None, op: str, fingerprint: str) -> bool:
    """An update that repeats the state the sensor has; ``before`` begins with operation and fingerprint."""
    return before is not None and op == UPDATE and before[0] != DELETE and before[1] == fingerprint


class _RealChanges(_InOrder):
    def __init__(self, waiting: T.StructType, output: T.StructType):
        self.waiting_schema, self.output = waiting, output
        self.current_schema = T.StructType.fromDDL("op string, fp string")

    def place(self, row: dict) -> tuple:
        return row["us"], row["seq"]

    def take(self, key, current, row):
        out = None if _same(current, row["op"], row["fp"]) else Row(**{n: row[n] for n in self.output.names})
        # what follows a delete counts whatever was before, so nothing need be known of it
        return (None if row["op"] == DELETE else (row["op"], row["fp"])), out


class _AsOf(_InOrder):
    def __init__(self, waiting: T.StructType, output: T.StructType):
        self.waiting_schema, self.output = waiting, output
        self.current_schema = T.StructType.fromDDL("op string, fp string, generation bigint, valid_from_us bigint")

    def place(self, row: dict) -> tuple:
        return row["us"], row["side"], row["seq"]

    def take(self, key, current, row):
        if row["side"] == EVENT:
            alive = current is not None and current[0] != DELETE
            return current, Row(payload=row["payload"], generation=current[2], valid_from_us=current[3]) if alive else None
        if _same(current, row["op"], row["fp"]):
            return (row["op"], *current[1:]), None
        generation = current[2] if current else 0
        if row["op"] == DELETE:
            return (DELETE, row["fp"], generation, None), None
        return (row["op"], row["fp"], generation + 1, row["us"]), None


def _use_rocksdb(spark: SparkSession) -> None:
    """Lists and timers in state need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _plain(df: DataFrame) -> list[Column]:
    """Columns with times as microseconds, which pass through Python unchanged."""
    return [micros(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema.fields]


def _restored(schema: T.StructType, at: str = "") -> list[Column]:
    return [F.timestamp_micros(F.col(at + f.name)).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(at + f.name) for f in schema.fields]


def _fingerprint(changes: DataFrame, spec: Column | None) -> Column:
    return object_fingerprint(changes, [c for c in changes.columns if c not in (*KEY, *ORDER, "op")]) if spec is None else spec.cast("string")


def drop_noop_updates_stream(changes: DataFrame, lateness: str = "10 minutes", spec: Column | None = None) -> DataFrame:
    """Stream of the changes that ``registry.drop_noop_updates`` keeps, each once the watermark has passed it.

    State per sensor is its last operation and fingerprint, and nothing after a delete that the watermark has passed.
    """
    _use_rocksdb(changes.sparkSession)
    marked = changes.withWatermark("ts", lateness).withColumn("_fp", _fingerprint(changes, spec))
    rows = marked.select(*KEY, micros(F.col("ts")).alias("us"), "seq", "op", F.col("_fp").alias("fp"), F.struct(*_plain(changes)).alias("payload"), "ts")
    waiting = T.StructType([f for f in rows.schema.fields if f.name in ("us", "seq", "op", "fp", "payload")])
    output = T.StructType([waiting["payload"]])
    kept = rows.groupBy(*KEY).transformWithState(_RealChanges(waiting, output), output, "append", "EventTime")
    return kept.select(*_restored(changes.schema, "payload."))


def route_asof_stream(events: DataFrame, changes: DataFrame, lateness: str = "10 minutes", spec: Column | None = None, salts: int = 8) -> DataFrame:
    """Stream of the events that meet a living generation of their sensor, with ``generation`` and ``valid_from``.

    ``events`` and ``changes`` are streams with ``sensor_key``, ``ts`` and ``seq``, changes with ``op`` too. The rows are those of
    ``registry.route_asof`` over ``registry.registry_intervals``, if no row comes more than ``lateness`` behind both streams. The
    watermark is that of the stream that lags, so a stream that is silent, also since a restart, holds it back: send a row now and then.
    """
    _use_rocksdb(events.sparkSession)
    payload = F.struct(*_plain(events))
    salt = F.pmod(F.xxhash64("seq"), F.lit(salts)).cast("int")
    found = events.withWatermark("ts", lateness).select(
        *KEY, salt.alias("salt"), micros(F.col("ts")).alias("us"), F.lit(EVENT).alias("side"), F.col("seq").cast("bigint").alias("seq"),
        F.lit(None).cast("string").alias("op"), F.lit(None).cast("string").alias("fp"), payload.alias("payload"), "ts",
    )
    payload_type = found.schema["payload"].dataType
    marked = changes.withWatermark("ts", lateness).withColumn("_fp", _fingerprint(changes, spec))
    told = marked.select(
        *KEY, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), micros(F.col("ts")).alias("us"), F.lit(CHANGE).alias("side"),
        F.col("seq").cast("bigint").alias("seq"), "op", F.col("_fp").alias("fp"), F.lit(None).cast(payload_type).alias("payload"), "ts",
    )
    rows = found.union(told)
    waiting = T.StructType([f for f in rows.schema.fields if f.name in ("us", "side", "seq", "op", "fp", "payload")])
    output = T.StructType([T.StructField("payload", payload_type), T.StructField("generation", T.LongType()), T.StructField("valid_from_us", T.LongType())])
    routed = rows.groupBy(*KEY, "salt").transformWithState(_AsOf(waiting, output), output, "append", "EventTime")
    return routed.select(*_restored(events.schema, "payload."), "generation", F.timestamp_micros("valid_from_us").alias("valid_from"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were dropped, over the progress that the query still holds."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])

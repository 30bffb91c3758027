"""Ordered scans over rows that are ranged by key and order, for any number of scans on one reading of the input.

``place`` deals rows to parts by ranges of (key, order) and stores them once. A part holds many small keys whole; a key that is too large for
a part goes on in the next ones, wherever its rows lie in time. A window runs per part and key. Only keys that lie in several parts
need more: of each part and such key one summary row, and what the earlier parts carry into it. There are at most two such keys in a
part, so these rows are fewer than twice the parts. The keys are known when rows are placed; without any a scan is its window alone.

Scans on one ``Placed`` follow one another on the same exchange, also after rows were left out. ``ordered.scan`` is the form that starts no job
and cuts keys by time.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.functions import ordered
from evspark.functions.ordered import Scan, _windows
from evspark.session import as_table

PART = "_part"


@dataclass(frozen=True)
class Placed:
    """Rows with the number of their part, and the keys that lie in several parts."""

    df: DataFrame
    split: DataFrame | None
    keys: list[str]
    order: list[str]

    def scan(self, within: list[str] = (), **outputs: Scan) -> Placed:
        """Add ``outputs``, scanned per key in order; ``within`` are more columns that divide the rows of a key."""
        keys = [*self.keys, *within]
        window = _windows([PART, *keys], self.order)
        local = self.df.withColumns({f"_here_{n}": s.local(window[s.backward]) for n, s in outputs.items()})
        columns = [*self.df.columns, *[n for n in outputs if n not in self.df.columns]]
        if self.split is None:
            found = {n: s.merge(F.col(f"_here_{n}"), F.lit(None)) for n, s in outputs.items()}
            return replace(self, df=local.withColumns(found).select(*columns))
        place = F.struct(*self.order)
        some = self.df.join(self.split, self.keys, "left_semi")
        summary = some.groupBy(*keys, PART).agg(*[s.summary(place).alias(f"_sum_{n}") for n, s in outputs.items()])
        across = _windows(keys, [PART])
        carried = summary.select(
            *[F.col(k).alias(f"_at_{k}") for k in (*keys, PART)],
            *[s.carry(F.col(f"_sum_{n}"), across[s.backward]).alias(f"_carry_{n}") for n, s in outputs.items()],
        )
        same = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in within] + [F.col(k) == F.col(f"_at_{k}") for k in (*self.keys, PART)]
        joined = local.join(carried, same, "left")
        merged = {n: s.merge(F.col(f"_here_{n}"), F.col(f"_carry_{n}")) for n, s in outputs.items()}
        return replace(self, df=joined.withColumns(merged).select(*columns))

    def where(self, condition: Column | str) -> Placed:
        return replace(self, df=self.df.where(condition))

    def select(self, *columns: Column | str) -> Placed:
        """Other columns; a later scan needs those of key and order, which keep their names or get them from ``by``."""
        return replace(self, df=self.df.select(*columns, PART))

    def by(self, order: list[str]) -> Placed:
        """The same rows where fewer columns give the order, as when rows of one kind are left."""
        return replace(self, order=order)

    def rows(self) -> DataFrame:
        return self.df.drop(PART)


def place(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> Placed:
    """Store ``df`` in parts ranged by ``keys`` and ``order``, which are not null; ``order`` should be unique within a key."""
    if df.isStreaming:
        raise ValueError("ordered scans need a bounded table")
    ranged = df.repartitionByRange(parts, *keys, *order) if parts else df.repartitionByRange(*keys, *order)
    stored = as_table(ranged.withColumn(PART, F.spark_partition_id()))
    ends = stored.groupBy(PART).agg(F.min(F.struct(*keys)).alias("first"), F.max(F.struct(*keys)).alias("last"))
    # a key in several parts is the first or the last of each
    each = ends.select(PART, F.explode(F.array_distinct(F.array("first", "last"))).alias("k"))
    split = each.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k.*")
    found = split.toArrow()  # fewer rows than parts
    return Placed(stored, df.sparkSession.createDataFrame(found) if found.num_rows else None, list(keys), list(order))


@dataclass(frozen=True)
class Sliced:
    """The same steps by ``ordered.scan``: nothing is stored, and keys are cut every ``width`` of their order."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    width: int

    def scan(self, within: list[str] = (), **outputs: Scan) -> Sliced:
        return replace(self, df=ordered.scan(self.df, [*self.keys, *within], self.order, self.width, **outputs))

    def where(self, condition: Column | str) -> Sliced:
        return replace(self, df=self.df.where(condition))

    def select(self, *columns: Column | str) -> Sliced:
        return replace(self, df=self.df.select(*columns))

    def by(self, order: list[str]) -> Sliced:
        return replace(self, order=order)

    def rows(self) -> DataFrame:
        return self.df


Ordered = Placed | Sliced


def in_order(df: DataFrame, keys: list[str], order: list[str], slice_width: int | None = None) -> Ordered:
    """Rows to scan: placed by ranges, or cut by time if ``slice_width`` is given."""
    return place(df, keys, order) if slice_width is None else Sliced(df, list(keys), list(order), slice_width)

"""A set of 64-bit numbers as a Bloom filter in files that all executors map.

The filter is built by Spark: numbers are dealt by their top bits to chunks, and one task writes a chunk's file. Members are always found;
others are found by chance, more often the fuller a filter of the largest size gets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm import shared

CHUNK_BITS = 5
BITS_PER_MEMBER = 16
PROBES = 4
MIN_BYTES, MAX_BYTES = 1 << 16, 256 << 20
"""Bytes of all files of a filter; workers map them, so they are the page cache's memory, once per machine."""


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser over 64-bit words."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _places(x: np.ndarray, bits: int) -> np.ndarray:
    low, step = x & np.uint64(0xFFFFFFF), ((x >> np.uint64(28)) & np.uint64(0x7FFFFFF)) | np.uint64(1)
    return ((low[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


def _chunk(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - CHUNK_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Bits:
    """A written filter; ``opened`` in a task."""

    folder: str
    chunk_bytes: int

    def opened(self) -> OpenBits:
        names = {f.base_name for f in shared.listed(self.folder)}
        parts = [np.frombuffer(shared.mapped(f"{self.folder}/{c:02d}"), np.uint8) if f"{c:02d}" in names else None for c in range(1 << CHUNK_BITS)]
        return OpenBits(parts, self.chunk_bytes * 8)


@dataclass
class OpenBits:
    parts: list[np.ndarray | None]
    bits: int

    def have(self, numbers: np.ndarray) -> np.ndarray:
        """Which of the numbers (uint64) may be members."""
        x = mixed(numbers)
        out, chunk, place = np.zeros(len(x), bool), _chunk(x), _places(x, self.bits)
        for c in np.unique(chunk):
            if self.parts[c] is not None:
                at = np.flatnonzero(chunk == c)
                out[at] = ((self.parts[c][place[at] >> 3] >> (place[at] & 7).astype(np.uint8)) & 1).all(1)
        return out


def write(numbers: DataFrame, count: int) -> Bits:
    """Filter of the ``count`` numbers in the first column (long) of a stored table."""
    wanted = max(MIN_BYTES, min(MAX_BYTES, 1 << (count * BITS_PER_MEMBER // 8).bit_length()))
    size = wanted >> CHUNK_BITS
    folder = shared.new_folder(numbers.sparkSession, "bits")
    shared.make_folder(folder)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = mixed(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(_chunk(x).astype(np.int32)), pa.array(x.view(np.int64))], names=["chunk", "x"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = None, np.empty(0, np.uint8)

        def close() -> None:
            if now is not None:
                out = shared.AtomicFile(f"{folder}/{now:02d}")
                out.write(table.tobytes())
                out.close()

        for batch in batches:
            chunk, x = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for c in np.unique(chunk).tolist():
                if c != now:
                    close()
                    now, table = c, np.zeros(size, np.uint8)
                place = _places(x[chunk == c], size * 8).ravel()
                np.bitwise_or.at(table, place >> 3, (1 << (place & 7)).astype(np.uint8))
        close()
        yield from ()

    rows = numbers.mapInArrow(dealt, "chunk int, x long").repartition(1 << CHUNK_BITS, "chunk").sortWithinPartitions("chunk")
    rows.mapInArrow(written, "chunk int").write.format("noop").mode("overwrite").save()
    return Bits(folder, size)

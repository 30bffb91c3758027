"""Repeated lines across documents, found with two Bloom filters (operator 10).

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased. Keys of at least
``min_chars`` code points that occur in two or more documents lose their lines everywhere but in the smallest id.

1. Hashes of keys, distinct within some hundred documents, are dealt by their top bits to chunks. The task of a chunk sets a hash's bits
   in a first filter (seen once) or, if it was there, in a second (seen twice), so a filter exists once, in pieces of
   ``MAX_FILTER_BYTES`` / ``CHUNKS`` bytes at most.
2. Only keys in the second filter leave their task. They are grouped in full, so a chance hit of the filter does no harm;
   a key's smallest and largest id, which combine on the map side, tell whether it repeats and where it stays.
3. Rows meet the keys that they lose by id and hash of their text, so a row carries keys of its own text only, and are rewritten.

Filters are files in the shared folder, sized from the number of all lines up to ``MAX_FILTER_BYTES`` and mapped by
the workers; nothing is broadcast. Past that size the second filter passes more keys, and results stay the same.

Definitions: a null or empty text is one empty line. Rows that share an id are one document; each is returned. A null id
counts as the largest id. Repeats within one document stay if no other document has the key. An empty
table gives no rows. Texts of any length are read whole. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm import shared

MIN_FILTER_BYTES = 1 << 20
MAX_FILTER_BYTES = 256 << 20
BITS_PER_LINE = 16
PROBES = 4
CHUNKS = 64
NULL_ID = (1 << 63) - 1


def keys_of(text: str | None) -> list[bytes]:
    """Key of every line; bytes.strip and bytes.lower touch ASCII only."""
    return [line.strip() for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= 4 * min_chars or (len(key) >= min_chars and len(key.decode("utf-8", "surrogatepass")) >= min_chars)


class Filters:
    """Bits of hashes, in chunks: the top bits of a hash choose the chunk, the others the places in it."""

    def __init__(self, chunk_bytes: int):
        self.bits = chunk_bytes * 8

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chunk = (hashes >> np.uint64(58)).astype(np.int64)
        low, step = hashes & np.uint64(0xFFFFFFF), ((hashes >> np.uint64(28)) & np.uint64(0xFFFFFFF)) | np.uint64(1)
        # 28 bits and an odd stride: enough for chunks of up to 32 MB
        return chunk, ((low[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(self.bits)).astype(np.int64)

    @staticmethod
    def have(table: np.ndarray, chunk: np.ndarray, place: np.ndarray) -> np.ndarray:
        return ((table[chunk[:, None], place >> 3] >> (place & 7).astype(np.uint8)) & 1).all(1)

    @staticmethod
    def put(table: np.ndarray, chunk: np.ndarray, place: np.ndarray) -> None:
        np.bitwise_or.at(table, (np.repeat(chunk, PROBES), (place >> 3).ravel()), (1 << (place & 7)).astype(np.uint8).ravel())


def _hashes(text: str | None, min_chars: int) -> np.ndarray:
    """Distinct hashes of a document's keys."""
    keys = {k for k in keys_of(text) if long_enough(k, min_chars)}
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def repeated_filter(docs: DataFrame, min_chars: int) -> tuple[str, int]:
    """Folder with the second filter's chunk files, and the size of one."""
    spark = docs.sparkSession
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    size = min(MAX_FILTER_BYTES, max(MIN_FILTER_BYTES, 1 << (int(lines) * BITS_PER_LINE // 8).bit_length())) // CHUNKS
    folder = shared.new_folder(spark, "line-filter")
    shared.make_folder(folder)
    schema = pa.schema([("chunk", pa.int32()), ("hash", pa.int64()), ("again", pa.bool_())])
    filters = Filters(size)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [_hashes(t, min_chars) for t in batch.column(0).slice(at, 256).to_pylist()]
                hashes, count = np.unique(np.concatenate(found), return_counts=True)
                chunk = (hashes >> np.uint64(58)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(hashes.view(np.int64)), pa.array(count > 1)], schema=schema)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def write() -> None:
            if now is not None:
                out = shared.AtomicFile(f"{folder}/{now:02d}")
                out.write(twice.tobytes())
                out.close()

        now, once, twice = None, np.empty(0), np.empty(0)
        for batch in batches:
            chunks, hashes, seen = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
            for c in np.unique(chunks).tolist():
                if c != now:
                    write()
                    now, once, twice = c, np.zeros((1, size), np.uint8), np.zeros((1, size), np.uint8)
                at = chunks == c
                some, back, count = np.unique(hashes[at], return_inverse=True, return_counts=True)
                place = filters.places(some)[1]
                only = np.zeros(len(some), np.int64)
                again = filters.have(once, only, place) | (count > 1) | (np.bincount(back, seen[at], len(some)) > 0)
                filters.put(twice, only[again], place[again])
                filters.put(once, only, place)
        write()
        yield from ()

    lines = docs.select("text").mapInArrow(hashed, "chunk int, hash long, again boolean")
    lines.repartition(CHUNKS, "chunk").sortWithinPartitions("chunk").mapInArrow(fill, "chunk int").write.format("noop").mode("overwrite").save()
    return folder, size


def dedup_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines (before), n_dropped, text (what is left) of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    folder, size = repeated_filter(docs, min_chars)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("id", pa.int64()), ("text_hash", pa.int64())])
        filters, empty = Filters(size), bytes(size)
        names = {f.base_name for f in shared.listed(folder)}
        table = np.stack([np.frombuffer(shared.mapped(f"{folder}/{c:02d}") if f"{c:02d}" in names else empty, np.uint8) for c in range(CHUNKS)])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [(k, i, h) for i, t, h in zip(*(c.to_pylist() for c in part.columns), strict=True) for k in {k for k in keys_of(t) if long_enough(k, min_chars)}]
                hit = filters.have(table, *filters.places(np.fromiter((xxhash.xxh3_64_intdigest(x[0]) for x in found), np.uint64, len(found))))
                found = [x for x, h in zip(found, hit.tolist(), strict=True) if h]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], schema.field(k).type) for k in range(3)], schema=schema)

    suspected = shared.stored(docs.select("id", "text", "text_hash").mapInArrow(suspects, "key binary, id long, text_hash long"), "suspects")
    stays = suspected.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("key", "first")
    # stored before the join, so that Spark can split a frequent line on either side
    stays = shared.stored(stays, "stays")
    lost = suspected.join(stays, "key").where("id <> first").groupBy("id", "text_hash").agg(F.collect_set("key").alias("keys"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.string())])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, dropped, texts = [], [], []
                for text, gone in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    lines = text.split("\n")
                    n.append(len(lines))
                    if gone:
                        gone = set(gone)
                        lines = [line for line, key in zip(lines, keys_of(text), strict=True) if key not in gone]
                        text = "\n".join(lines)
                    dropped.append(n[-1] - len(lines))
                    texts.append(text)
                ids = part.column(0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())], schema=schema)

    return docs.join(lost, ["id", "text_hash"], "left").select("doc_id", "text", "keys").mapInArrow(rewrite, "doc_id long, n_lines long, n_dropped long, text string")

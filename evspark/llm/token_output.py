"""Token ids as flat binary files with 64-bit document offsets (operator 1).

A shard is three files: ``NNNNNN.ids`` (unsigned integers of the smallest of 16 and 32 bits that holds the
vocabulary, little-endian, documents one after another), ``.offsets`` (int64, one more than documents, local to the
shard) and ``.docs`` (int64 document ids). The ``manifest`` table has one row per shard with the number of all
ids before it, the prefix sum over the shards. Shards follow one another in ascending document id.

Definitions: a null text is empty; every document ends with ``end_id``, an empty one is ``end_id`` alone. Null
document ids come first. Rows with the same id are separate documents, in order of the hash of their text. An
empty table makes a manifest without rows. Texts of any length are encoded whole. Other columns, whatever their names, are not read.

Scale: one range exchange of (id, text). Tasks write shards through the shared folder under a temporary name
and rename them when complete, so a lost task is repeated without harm. Per shard one row reaches the driver's plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evspark.llm import shared, units

SHARD = "shard int, ids_file string, offsets_file string, docs_file string, width int, null_docs long, docs long, ids long"
TOKENS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def id_type(vocabulary: int, end_id: int) -> np.dtype:
    return np.dtype("<u2" if max(vocabulary - 1, end_id) < 1 << 16 else "<u4")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards and manifest of all documents below ``folder``; returns the manifest (shard, files, sizes, base)."""
    spark = docs.sparkSession
    dtype = id_type(units.vocabulary_size(tokenizer), end_id)
    end = np.array([end_id], dtype).tobytes()
    shared.make_folder(f"{folder}/shards")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, total, nulls, docs_seen, files = TaskContext.get().partitionId(), dtype.itemsize, 0, 0, 0, None
        name = f"{folder}/shards/{shard:06d}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                files = [shared.AtomicFile(f"{name}.{kind}") for kind in ("ids", "offsets", "docs")]
                files[1].write(np.zeros(1, "<i8"))
            ids, texts = batch.column(0), batch.column(1).fill_null("").to_pylist()
            for start in range(0, len(texts), 512):
                encoded = units.ids_of(tokenizer, texts[start : start + 512], dtype)
                ends = total + np.cumsum([len(x) // size + 1 for x in encoded])
                total = int(ends[-1])
                files[0].write(end.join(encoded) + end)
                files[1].write(ends.astype("<i8"))
            files[2].write(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            nulls, docs_seen = nulls + ids.null_count, docs_seen + batch.num_rows
        if files is None:
            return
        for f in files:
            f.close()
        row = {"shard": shard, "ids_file": f"{name}.ids", "offsets_file": f"{name}.offsets", "docs_file": f"{name}.docs", "width": size, "null_docs": nulls, "docs": docs_seen, "ids": total}
        yield pa.RecordBatch.from_pylist([row], schema=shard_schema)

    shard_schema = pa.schema([("shard", pa.int32()), ("ids_file", pa.string()), ("offsets_file", pa.string()), ("docs_file", pa.string()), ("width", pa.int32()), ("null_docs", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())])
    tie = F.xxhash64(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), tie.alias("tie"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    ordered.mapInArrow(write, SHARD).write.parquet(f"{folder}/shard_rows")
    # one row per shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    made = spark.read.schema(SHARD).parquet(f"{folder}/shard_rows")
    made.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{SHARD}, base long").parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files: id, first position among all ids, length, checksum, and the ids themselves on request.

    ``ids_crc32`` is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in (row for b in batches for row in b.to_pylist()):
            ids = np.frombuffer(shared.mapped(shard["ids_file"]), f"<u{shard['width']}")
            offsets = np.frombuffer(shared.mapped(shard["offsets_file"]), "<i8")
            doc_ids = np.frombuffer(shared.mapped(shard["docs_file"]), "<i8")
            null = np.arange(len(doc_ids)) < shard["null_docs"]
            for at in range(0, len(doc_ids), 4096):
                ends = offsets[at : at + 4097]
                some = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                crc = [zlib.crc32(x.astype("<u4")) for x in some]
                columns = [pa.array(doc_ids[at : at + 4096], mask=null[at : at + 4096]), pa.array(ends[:-1] + shard["base"]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([x.astype("i8") for x in some], schema.field(4).type)] * with_ids if with_ids else columns, schema=schema)

    manifest = read_manifest(spark, folder)
    return manifest.repartition(spark.sparkContext.defaultParallelism * 2, "shard").mapInArrow(read, TOKENS + ", ids array<long>" * with_ids)


def token_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write all documents to a new folder of shards and read it back (see ``read_tokens``)."""
    folder = shared.new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer, end_id)
    return read_tokens(docs.sparkSession, folder)

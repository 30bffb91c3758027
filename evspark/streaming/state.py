"""Streaming counts, sessions and the registry table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evspark.operators.registry import registry_current
from evspark.operators.state import RUN


def sensor_state_stream(routed: DataFrame) -> DataFrame:
    """Count and last event per generation; write in update mode."""
    return routed.groupBy(*RUN).agg(F.count("*").alias("n_events"), F.max("ts").alias("last_ts"))


def activity_sessions_stream(routed: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Closed activity sessions; the gap is the idle period ``idle_s`` of each row's sensor."""
    gap = F.concat(F.col("idle_s").cast("string"), F.lit(" seconds"))
    return (
        routed.withWatermark("ts", lateness)
        .groupBy(*RUN, F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n_events"))
        .select(*RUN, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")
    )


BUCKETS = 64


def read_registry(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """Registry table written by :func:`registry_stream`; None before the first version that holds rows."""
    if version is None:
        version = max(_versions(spark, path), default=None)
    held = {} if version is None else _manifest(spark, path, version)
    return _buckets(spark, path, held) if held else None


def _buckets(spark: SparkSession, path: str, held: dict[int, int]) -> DataFrame:
    folders = [f"{path}/data/batch={b}/bucket={k}" for k, b in sorted(held.items())]
    return spark.read.option("basePath", f"{path}/data").parquet(*folders).drop("batch", "bucket")


def _manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """Bucket: batch whose files hold it. One row per bucket."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v={version}").where("bucket >= 0").collect()
    return {r["bucket"]: r["batch"] for r in rows}


MANIFEST = "bucket int, batch long, newest timestamp"


def registry_stream(changes: DataFrame, path: str, checkpoint: str, keep: int = 2, buckets: int = BUCKETS, lateness: str | None = None) -> StreamingQuery:
    """Keep the current registry in hash buckets of ``sensor_key``; a micro-batch rewrites those that it touches.

    Batch n merges its changes with what the version below n holds of the buckets touched, writes these below ``data/batch=n``, and then
    version n of the manifest, which names the batch of every bucket. A batch that runs again after a failure writes the same
    content to the same place. Files that none of the last ``keep`` versions names are deleted. Deletes stay in the table as
    tombstones, because an older change may still arrive; with ``lateness``, those that are older than the newest change by
    more than that are left out when their bucket is rewritten.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("sensor_key"), F.lit(buckets)).cast("int").alias("bucket")
        older = sorted(v for v in _versions(spark, path) if v < batch_id)
        held = _manifest(spark, path, older[-1]) if older else {}
        stats = batch.groupBy(bucket).agg(F.max("ts").alias("newest")).collect()  # a row per bucket
        touched = {r["bucket"] for r in stats}
        times = [r["newest"] for r in stats if r["newest"] is not None]
        if older:
            times += [r["newest"] for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v={older[-1]}").where("bucket < 0").collect() if r["newest"]]
        newest, before = max(times, default=None), {k: b for k, b in held.items() if k in touched}
        state = batch.unionByName(_buckets(spark, path, before)) if before else batch
        rest = [c for c in batch.columns if c != "sensor_key"]
        merged = state.groupBy("sensor_key").agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("r")).select("sensor_key", "r.*")
        if lateness is not None and newest is not None:
            over = F.col("ts") < F.lit(newest) - F.expr(f"interval {lateness}")
            merged = merged.where(~((F.col("op") == "DELETE") & over))
        merged.select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={batch_id}")
        written = {int(n.split("=")[1]) for n in _folder(spark, f"{path}/data/batch={batch_id}").names() if n.startswith("bucket=")}
        now = {k: b for k, b in held.items() if k not in touched} | dict.fromkeys(written, batch_id)
        rows = [(k, b, None) for k, b in sorted(now.items())] + [(-1, batch_id, newest)]
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={batch_id}")
        _drop_unused(spark, path, [*older, batch_id], keep)

    return (
        changes.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _drop_unused(spark: SparkSession, path: str, versions: list[int], keep: int) -> None:
    """Delete old versions of the manifest and the buckets that only they name."""
    kept, gone = versions[-1 - keep :], versions[: -1 - keep]
    if not gone:
        return
    used = {(b, k) for v in kept for k, b in _manifest(spark, path, v).items()}
    for b, k in {(b, k) for v in gone for k, b in _manifest(spark, path, v).items()} - used:
        _folder(spark, f"{path}/data/batch={b}/bucket={k}").delete()
    for v in gone:
        _folder(spark, f"{path}/manifest/v={v}").delete()


def current_registry(spark: SparkSession, path: str) -> DataFrame | None:
    table = read_registry(spark, path)
    return None if table is None else registry_current(table)


class _folder:
    """A folder on the cluster file system, through Hadoop."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path)] if self.fs.exists(self.path) else []

    def has(self, name: str) -> bool:
        return name in self.names()

    def delete(self) -> None:
        self.fs.delete(self.path, True)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose write was committed."""
    found = [int(n[2:]) for n in _folder(spark, f"{path}/manifest").names() if n.startswith("v=")]
    return [v for v in found if _folder(spark, f"{path}/manifest/v={v}").has("_SUCCESS")]

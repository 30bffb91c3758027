"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "evspark", **conf: str) -> SparkSession:
    """Session with the settings the library relies on (UTC, AQE with skew handling)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # no Python call site per column: building a plan takes half the time
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """New folder below ``spark.checkpoint.dir``; a local folder only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="evspark-")
    return f"{base.rstrip('/')}/evspark-{uuid.uuid4().hex}"


def as_table(df: DataFrame) -> DataFrame:
    """Write to the shared working folder and read back.

    Cuts the lineage of a frame that several branches of a job read; the files survive
    the loss of executors and give Spark their size.
    """
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """A table of few rows, of which Spark knows the size of its input only: broadcast, unless the session does without broadcasts."""
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return df if limit.strip().startswith("-") else F.broadcast(df)

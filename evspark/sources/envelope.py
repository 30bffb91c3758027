"""The event envelope: identity (family, source, seq), time and six string fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.functions.columns import micros, text

FIELDS = ["namespace", "source", "type", "version", "data", "uuid"]
COLUMNS = ["family", "seq", "ts", *FIELDS]
IDENTITY = ["family", "source", "seq"]
# the order of a sensor's events: time, then identity, so that ties are decided in the same way everywhere
ORDER = ["ts", "seq", "family", "source"]


def envelope(df: DataFrame, family: str, seq: Column, ts: Column, keep: tuple[str, ...] = (), **fields: Column) -> DataFrame:
    """Project a feed onto the envelope; fields not given are the empty string."""
    unknown = set(fields) - set(FIELDS)
    if unknown:
        raise ValueError(f"not envelope fields: {sorted(unknown)}")
    return df.select(
        F.lit(family).alias("family"),
        seq.cast("bigint").alias("seq"),
        ts.cast("timestamp").alias("ts"),
        *[text(fields[f]).alias(f) if f in fields else F.lit("").alias(f) for f in FIELDS],
        *keep,
    )


def fresh_uuid(deterministic: bool) -> Column:
    """Event id. The derived form gives the same id when a lost task runs again."""
    if deterministic:
        return F.md5(F.concat_ws("#", *[F.col(c).cast("string") for c in IDENTITY]))
    return F.uuid()


def fill_uuid(df: DataFrame, deterministic: bool = True) -> DataFrame:
    return df.withColumn("uuid", F.when(F.col("uuid") == "", fresh_uuid(deterministic)).otherwise(F.col("uuid")))


def fill_version(df: DataFrame) -> DataFrame:
    nanos = (micros(F.col("ts")) * 1000).cast("string")
    return df.withColumn("version", F.when(F.col("version") == "", nanos).otherwise(F.col("version")))


def envelope_defaults(df: DataFrame, deterministic: bool = True) -> DataFrame:
    """Empty uuid becomes an event id, empty version the event time in nanoseconds."""
    return fill_version(fill_uuid(df, deterministic))


def union_events(*feeds: DataFrame) -> DataFrame:
    """All families as one typed stream or table."""
    return reduce(DataFrame.unionByName, [f.select(*COLUMNS) for f in feeds])


def event_payload(df: DataFrame, name: str = "payload") -> DataFrame:
    """Base64 of the event as JSON, the form forwarded with a request (one line, as a header needs)."""
    body = F.to_json(F.struct(*FIELDS))
    return df.withColumn(name, F.translate(F.base64(F.encode(body, "UTF-8")), "\r\n", ""))

"""Feed adapters: one projection per trigger family, on tables and on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.functions.columns import text
from evspark.settings import DEFAULTS
from evspark.sources.envelope import envelope, fill_uuid, fill_version

KAFKA_POLICIES = ("earliest", "latest")
# Event sequence of a log record: partition in the high bits, offset below.
PARTITION_SHIFT = 44


def read_kafka(spark: SparkSession, servers: str, topics: str, policy: str = "latest", streaming: bool = True, **options: str) -> DataFrame:
    """Kafka source; needs the public Kafka connector package on the class path."""
    _check_policy(policy)
    reader = spark.readStream if streaming else spark.read
    reader = reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
    if streaming or policy == "earliest":
        reader = reader.option("startingOffsets", policy)
    return reader.options(**options).load()


def from_kafka(df: DataFrame, deterministic: bool = True) -> DataFrame:
    partition, offset = F.col("partition").cast("bigint"), F.col("offset")
    fits = (partition < 1 << 63 - PARTITION_SHIFT) & (offset < 1 << PARTITION_SHIFT)
    seq = F.when(fits, F.shiftleft(partition, PARTITION_SHIFT) + offset).otherwise(F.raise_error(F.lit("partition or offset too large for an event number")))
    events = envelope(
        df, "kafka", seq, F.col("timestamp"),
        type=F.lit("kafka"), source=F.col("topic"), data=F.col("value").cast("string"),
    )
    return fill_uuid(events, deterministic)


def partition_end_offsets(df: DataFrame) -> DataFrame:
    """Next offset to be written, per topic partition."""
    return df.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))


def kafka_start(df: DataFrame, policy: str, end_offsets: DataFrame | None = None) -> DataFrame:
    """Records a consumer sees under a start policy.

    ``latest`` drops what was written before ``end_offsets`` was taken; a partition
    missing there is new and is read from its beginning.
    """
    _check_policy(policy)
    if policy == "earliest":
        return df
    if end_offsets is None:
        raise ValueError("latest needs the end offsets at the time of subscription")
    joined = df.join(end_offsets, ["topic", "partition"], "left")
    return joined.where(F.col("offset") >= F.coalesce("end_offset", F.lit(0))).select(*df.columns)


def _check_policy(policy: str) -> None:
    if policy not in KAFKA_POLICIES:
        raise ValueError(f"offset policy must be one of {KAFKA_POLICIES}, not {policy!r}")


def from_mqtt(df: DataFrame) -> DataFrame:
    return envelope(
        df, "mqtt", F.col("seq"), F.col("ts"),
        type=F.lit("mqtt"), source=F.col("topic"), data=F.col("payload").cast("string"),
    )


def from_redis(df: DataFrame) -> DataFrame:
    """Pub/sub messages; their type stays empty."""
    return envelope(df, "redis", F.col("seq"), F.col("ts"), source=F.col("channel"), data=F.col("payload").cast("string"))


def header(headers: Column, name: str) -> Column:
    """Value of a request header, looked up without regard to letter case."""
    same = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.get(same, F.lit(0))["value"]


def from_http(df: DataFrame, uuid_header: str = DEFAULTS.uuid_header, deterministic: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    events = envelope(
        df, "http", F.col("seq"), F.col("ts"), keep,
        type=F.lit("http"), data=F.col("body").cast("string"), uuid=text(header(F.col("headers"), uuid_header)),
    )
    return fill_version(fill_uuid(events, deterministic))


def from_k8s_events(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cluster events; only additions count."""
    return envelope(
        df.where(F.col("op") == "ADD"), "k8s_events", F.col("seq"), F.col("ts"), keep,
        namespace=F.col("namespace"), source=F.col("source"), type=F.col("type"),
        version=F.col("api_version"), data=F.col("message"),
    )


def from_cloud_events(df: DataFrame) -> DataFrame:
    return envelope(
        df, "cloud_events", F.col("seq"), F.col("ts"),
        source=F.col("source"), type=F.col("type"), version=F.col("specversion"), data=F.col("data"),
    )


def cloud_events_from_json(df: DataFrame, body: str = "value") -> DataFrame:
    """Structured-mode CloudEvents: the attributes are members of one JSON object."""
    schema = "source string, type string, specversion string, data string, time timestamp"
    return df.withColumn("_e", F.from_json(F.col(body), schema)).select("*", "_e.*").drop("_e")

"""Resource manifests: decoding, group/version/resource names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.functions.columns import plural, text

CONTAINERS = "array<struct<name:string>>"
SCHEMA = (
    "apiVersion string, kind string, "
    "metadata struct<namespace:string,name:string,labels:map<string,string>>, "
    f"spec struct<replicas:int,selector:struct<matchLabels:map<string,string>>,containers:{CONTAINERS},"
    f"template:struct<spec:struct<containers:{CONTAINERS}>>>"
)
NO_LABELS = "map<string,string>"


def manifest(value: Column) -> Column:
    """Manifest JSON as a flat struct; null when it is not a JSON object."""
    m = F.from_json(value, SCHEMA)
    empty = F.create_map().cast(NO_LABELS)
    pods = F.when(
        m["kind"] == "Job", m["spec"]["template"]["spec"]["containers"]
    ).otherwise(m["spec"]["containers"])
    decoded = F.struct(
        text(m["apiVersion"]).alias("api_version"),
        text(m["kind"]).alias("kind"),
        text(m["metadata"]["namespace"]).alias("namespace"),
        text(m["metadata"]["name"]).alias("name"),
        F.coalesce(m["metadata"]["labels"], empty).alias("labels"),
        m["spec"]["selector"]["matchLabels"].alias("match_labels"),
        m["spec"]["replicas"].alias("replicas"),
        F.coalesce(F.transform(pods, lambda c: text(c["name"])), F.array().cast("array<string>")).alias("containers"),
    )
    return F.when(F.get_json_object(value, "$").startswith("{"), decoded)


def decode_manifest(df: DataFrame, value: str = "manifest") -> DataFrame:
    return df.withColumn("obj", manifest(F.col(value)))


def gvr(api_version: Column, kind: Column) -> Column:
    """Group, version and resource of an API version and kind."""
    parts = F.split(api_version, "/")
    return F.struct(
        F.when(F.size(parts) == 2, parts[0]).otherwise("").alias("group"),
        F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).when(F.size(parts) == 1, parts[0]).otherwise("").alias("version"),
        plural(kind).alias("resource"),
    )

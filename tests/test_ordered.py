"""The ordered scan gives the same rows whatever the slices."""

import random

import pytest
from pyspark.sql import functions as F

from evspark.functions import ordered
from evspark.functions.ordered import following_row, last_value, next_value, previous_row, running_max, running_sum, scan

KEYS, ORDER = ["key"], ["ts", "seq"]


def outputs():
    v = F.col("v")
    return dict(
        carried=last_value(v), coming=next_value(v), top=running_max(v), total=running_sum(F.lit(1).cast("bigint")),
        before=previous_row(F.struct("ts", "v")), after=following_row(F.struct("ts", "v")),
    )


def naive(rows):
    """The six outputs by plain loops."""
    out = []
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3])
        for i, (_, ts, seq, v) in enumerate(group):
            past = [g[3] for g in group[: i + 1] if g[3] is not None]
            future = [g[3] for g in group[i:] if g[3] is not None]
            before = (group[i - 1][1], group[i - 1][3]) if i else None
            after = (group[i + 1][1], group[i + 1][3]) if i + 1 < len(group) else None
            out.append((key, ts, seq, v, past[-1] if past else None, future[0] if future else None, max(past, default=None), i + 1, before, after))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [1000, 20, 7, 1])
def test_scan_equals_loops(spark, width):
    rng = random.Random(width)
    # one key holds most rows, with many equal times
    rows = [
        (rng.choice(["hot"] * 8 + ["a", "b"]), rng.randrange(-20, 40), i, rng.choice([None, None, rng.randrange(9)]))
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "key string, ts bigint, seq bigint, v int").repartition(5)
    got = scan(df, KEYS, ORDER, width=width, **outputs())
    assert got.columns == ["key", "ts", "seq", "v", *outputs()]
    plain = sorted(
        ((*r[:-2], tuple(r["before"]) if r["before"] else None, tuple(r["after"]) if r["after"] else None) for r in got.collect()),
        key=repr,
    )
    assert plain == naive(rows)


def test_a_hot_key_is_cut_by_time(spark):
    df = spark.range(2400).selectExpr("'hot' key", "timestamp_seconds(id * 3600) ts", "id seq")
    sizes = [r["count"] for r in df.groupBy(ordered._slice(df, "ts", ordered.SLICE)).count().collect()]
    assert sizes == [24] * 100


def test_building_a_scan_starts_no_job(spark):
    df = spark.range(300).selectExpr("string(id % 30) key", "id ts", "id seq", "id v")
    spark.sparkContext.setJobGroup("scan", "scan")
    scan(df, KEYS, ORDER, **outputs())
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("scan")) == []


def test_streams_are_refused(spark, tmp_path):
    spark.range(1).selectExpr("'a' key", "id ts", "id seq").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts bigint, seq bigint").parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        scan(stream, KEYS, ORDER, total=running_sum(F.lit(1)))

"""Scans over placed rows give the same rows whatever the parts, read their input once and spread a hot key."""

import random

import pytest
from pyspark.sql import functions as F
from test_ordered import KEYS, ORDER, naive, outputs

from evspark.functions.ordered import last_value, previous_row, running_sum
from evspark.functions.ranged import PART, in_order, place


def plain(df):
    return sorted(((*r[:-2], tuple(r["before"]) if r["before"] else None, tuple(r["after"]) if r["after"] else None) for r in df.collect()), key=repr)


def mixed_rows(seed):
    rng = random.Random(seed)
    # one key holds most rows, with many equal times
    return [(rng.choice(["hot"] * 8 + ["a", "b", "c"]), rng.randrange(-20, 40), i, rng.choice([None, None, rng.randrange(9)])) for i in range(400)]


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_scan_equals_loops(spark, parts):
    rows = mixed_rows(parts)
    df = spark.createDataFrame(rows, "key string, ts bigint, seq bigint, v int").repartition(5)
    got = place(df, KEYS, ORDER, parts).scan(**outputs()).rows()
    assert got.columns == ["key", "ts", "seq", "v", *outputs()]
    assert plain(got) == naive(rows)


@pytest.mark.parametrize("parts", [2, 13])
def test_scans_follow_one_another(spark, parts):
    """Rows are left out between two scans, also all rows that a key has in some part."""
    rows = mixed_rows(parts)
    df = spark.createDataFrame(rows, "key string, ts bigint, seq bigint, v int")
    first = place(df, KEYS, ORDER, parts).scan(_n=running_sum(F.lit(1).cast("bigint")))
    kept = first.where("_n % 3 = 0 and not (_n between 60 and 200)").select("key", "ts", "seq", "v")
    left = []
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3])
        left += [r for n, r in enumerate(group, 1) if n % 3 == 0 and not 60 <= n <= 200]
    assert plain(kept.scan(**outputs()).rows()) == naive(left)


@pytest.mark.parametrize("parts", [1, 9])
def test_scan_within_a_key(spark, parts):
    rows = [("hot" if i % 3 else "a", i, i, i // 50) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, ts bigint, seq bigint, era int")
    got = place(df, KEYS, ORDER, parts).scan(["era"], n=running_sum(F.lit(1).cast("bigint"))).rows().collect()
    seen = {}
    for key, _, seq, era in rows:
        seen.setdefault((key, era), []).append(seq)
    assert {r["seq"]: r["n"] for r in got} == {s: n for some in seen.values() for n, s in enumerate(some, 1)}


def test_a_key_that_is_hot_within_a_day_is_split(spark):
    df = spark.range(6000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id)) key", "timestamp_millis(id) ts", "id seq")
    placed = place(df, ["key"], ["ts", "seq"], 12)
    sizes = {r[PART]: r["count"] for r in placed.df.where("key = 'hot'").groupBy(PART).count().collect()}
    assert len(sizes) >= 4 and max(sizes.values()) <= 1000
    assert [r["key"] for r in placed.split.collect()].count("hot") == 1
    assert placed.split.count() <= 12
    got = placed.scan(n=running_sum(F.lit(1).cast("bigint"))).rows().where("key = 'hot'").selectExpr("max(n) n", "count(distinct n) d").first()
    assert (got["n"], got["d"]) == (2000, 2000)


def test_two_scans_use_one_exchange_of_rows(spark):
    df = spark.createDataFrame(mixed_rows(1), "key string, ts bigint, seq bigint, v int")
    placed = place(df, KEYS, ORDER, 4).scan(a=last_value(F.col("v"))).where("a is not null").scan(b=previous_row(F.struct("a")))
    plan = placed.rows()._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "CartesianProduct" not in plan
    # the windows over rows; those over the few rows of split keys are below a broadcast
    rows_side = plan.split("BroadcastExchange")[0]
    assert rows_side.count("Window [") == 2


def test_without_split_keys_a_scan_is_its_window(spark):
    df = spark.range(60).selectExpr("concat('k', id % 20) key", "id ts", "id seq", "int(id % 5) v")
    placed = place(df, KEYS, ORDER, 1)
    assert placed.split is None
    plan = placed.scan(**outputs()).rows()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_empty_and_streams(spark, tmp_path):
    df = spark.createDataFrame([], "key string, ts bigint, seq bigint, v int")
    assert place(df, KEYS, ORDER).scan(**outputs()).rows().collect() == []
    spark.range(1).selectExpr("'a' key", "id ts", "id seq").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts bigint, seq bigint").parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        place(stream, KEYS, ORDER)


def test_both_forms_agree(spark):
    rows = mixed_rows(7)
    df = spark.createDataFrame(rows, "key string, ts bigint, seq bigint, v int")
    for form in (in_order(df, KEYS, ORDER), in_order(df, KEYS, ORDER, slice_width=7)):
        assert plain(form.scan(**outputs()).where("true").rows()) == naive(rows)

import random
from collections import defaultdict
from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qatlam.operators import balance as B

COLUMNS = "k string, i long, r long, v double, t timestamp, extra string"


@given(st.dictionaries(st.integers(0, 50), st.integers(0, 1000), max_size=40), st.dictionaries(st.text("abc", min_size=1, max_size=3), st.integers(1, 5000), max_size=5), st.integers(1, 16))
def test_bins_are_even(buckets, hot, bins):
    of_bucket, of_hot = B.pack_bins(buckets, hot, bins)
    assert of_bucket.keys() == buckets.keys() and of_hot.keys() == hot.keys()
    filled = [0.0] * bins
    for b, i in of_bucket.items():
        filled[i] += buckets[b]
    for k, ids in of_hot.items():
        for i in ids:
            filled[i] += hot[k] / len(ids)
    share = max(1.0, (sum(buckets.values()) + sum(hot.values())) / bins)
    # largest-first packing: no bin is above its share by more than one load
    assert max(filled) <= share + max([share, *buckets.values()]) + 1e-6


def skewed():
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        k = "hot" if rng.random() < 0.5 else None if rng.random() < 0.05 else f"k{rng.randrange(200)}"
        row = (k, i if rng.random() > 0.01 else None, rng.randrange(40) if rng.random() > 0.1 else None, rng.choice([0.25, 0.5, None]), datetime(2025, 1, 1 + i % 28), "x")
        rows.append(row)
        if rng.random() < 0.05:
            rows.append((*row[:4], datetime(2025, 3, 1), "again"))
    return rows


def test_summary(spark):
    rows = skewed()
    expected = defaultdict(dict)
    for k, i, r, v, t, _ in rows:
        if k is not None and i is not None:
            old = expected[k].get(i)
            expected[k][i] = (r, v, max(t, old[2]) if old else t)
    got = {x["k"]: x for x in B.key_summary(spark.createDataFrame(rows, COLUMNS), "k", "i", "r", "v", "t", bins=6).collect()}
    assert got.keys() == expected.keys()
    for k, ids in expected.items():
        values = [v for _, v, _ in ids.values() if v is not None]
        x = got[k]
        assert (x["ids"], x["records"]) == (len(ids), len({r for r, _, _ in ids.values() if r is not None}))
        assert x["mean_v"] == (pytest.approx(sum(values) / len(values), abs=1e-6) if values else None)
        assert x["latest_t"] == max(t for _, _, t in ids.values())


def test_hot_key_is_spread(spark):
    df = spark.createDataFrame(skewed(), COLUMNS)
    plan = B.Balance(df, F.col("k"), bins=6)
    assert len(plan.hot["=hot"]) >= 3
    sizes = [x["count"] for x in plan.fragment(df.where("k is not null"), F.col("k"), F.col("i")).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
    assert max(sizes) < 2 * sum(sizes) / 6


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join(spark, how):
    left = spark.createDataFrame(skewed(), COLUMNS).select("k", "i", "extra")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k7", 3), ("stranger", 4), (None, 5)], "k string, w int")
    got = B.fragment_replicate_join(left, right, "k", F.col("i"), how, bins=5)
    want = left.join(right, "k", how)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_empty_and_refused(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert B.key_summary(empty, "k", "i", "r", "v", "t").count() == 0
    assert B.fragment_replicate_join(empty, spark.createDataFrame([("a", 1)], "k string, w int"), "k", F.col("i")).count() == 0
    with pytest.raises(ValueError):
        B.fragment_replicate_join(empty, empty, "k", F.col("i"), "full")


def test_one_long_key(spark):
    df = spark.createDataFrame([("y" * 5000, n, n, 1.0, None, "") for n in range(50)], COLUMNS)
    assert B.key_summary(df, "k", "i", "r", "v", "t", bins=4).first()["ids"] == 50


@pytest.mark.parametrize("length", [5, 2000])
def test_hot_key_of_any_length_is_split(spark, length):
    """Two long keys that differ in their last character only are two keys, and the hot one is in shards."""
    hot, other = "y" * (length - 1) + "1", "y" * (length - 1) + "2"
    df = spark.range(3000).select(F.when(F.col("id") < 2000, hot).when(F.col("id") < 2400, other).otherwise(F.concat(F.lit("k"), "id")).alias("k"), F.col("id").alias("i"))
    plan = B.Balance(df, F.col("k"), bins=8)
    assert sorted(len(x) for x in plan.hot.values())[-1] >= 5
    sizes = [x["count"] for x in plan.fragment(df, F.col("k"), F.col("i")).groupBy("__bin").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.5 * 3000 / 8
    got = {x["k"]: x["ids"] for x in B.key_summary(df, "k", "i", bins=8).collect()}
    assert (got[hot], got[other], len(got)) == (2000, 400, 602)


def test_all_bins_of_a_large_cluster_are_used(spark):
    df = spark.range(60_000).select(F.concat(F.lit("k"), F.col("id") % 40_000).alias("k"), "id")
    plan = B.Balance(df, F.col("k"), bins=20_000)
    assert plan.count >= 16 * 20_000
    bins = {x["__bin"] for x in plan.buckets.collect()} | {b for shards in plan.hot.values() for b in shards}
    assert len(bins) == 20_000

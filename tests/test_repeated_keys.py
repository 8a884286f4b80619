"""Repeated and NULL keys: quotas stay exact, pools and holdouts stay apart."""
import pytest
from pyspark.sql import functions as F

from synthlab.operators import sampling as S


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one key, some of them equal in every column; some keys are NULL."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") + 1000)
    return spark.range(3000).select(key.alias("k"), (F.col("id") % 4).alias("v"), (F.col("id") % 5 == 0).cast("int").alias("y"))


@pytest.mark.parametrize("n", [0, 1, 100, 999, 1500, 2999, 3000, 5000])
@pytest.mark.parametrize("seed", [1, 2, 3, 11])
def test_cap_is_exact(hot, n, seed):
    got = S.cap(hot, ["k"], n, seed)
    assert got.columns == hot.columns and got.count() == min(n, 3000)
    # chosen rows are rows of the table, each at most as often as there
    left = got.groupBy(*hot.columns).count().join(
        hot.groupBy(*hot.columns).agg(F.count("*").alias("all")), hot.columns, "left_outer").where("k is not null and coalesce(all, 0) < count")
    assert left.count() == 0


def test_splits_and_holdouts_are_exact(hot):
    for seed in (1, 5):
        split = S.stratified_split(hot, ["k"], "y", seed)
        assert split.count() == 3000 and split.where("split = 'test'").count() == 600
        assert split.where("split = 'test' and y = 1").count() == 120
        assert S.fixed_holdout(hot, ["k"], "y", 500, seed).count() == 500
        assert S.small_n_stratified(hot, ["k"], "y", 200, seed).count() == 200
        assert S.random_split(hot, ["k"], seed, 0.1).where("split = 'test'").count() == 300


def test_same_rows_each_time(hot):
    a, b = S.cap(hot, ["k"], 700, 3), S.cap(hot.repartition(5), ["k"], 700, 3)
    assert a.exceptAll(b).count() == 0


def test_equal_rows_spread_over_tasks(spark):
    same = spark.range(200_000).select(F.lit(1).alias("k"), F.lit("x").alias("v"))
    got = S.cap(same, ["k"], 150_000, 1)
    assert got.count() == 150_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # as with large partitions
    try:
        parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 2 and max(parts) < 100_000


def test_null_keys_stay_apart(hot):
    holdout = S.fixed_holdout(hot, ["k"], "y", 1200, 4)
    pool = S.pool_without(hot, holdout, ["k"])
    assert holdout.where("k is null").count() > 0
    assert pool.where("k is null").count() == 0 and S.leak_check(pool, holdout, ["k"]).count() == 0
    assert S.leak_check(hot.where("k is null"), holdout, ["k"]).count() == hot.where("k is null").count()

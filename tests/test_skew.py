import pytest
from support import plan_of, rows
from pyspark.sql import functions as F

from cinefold.plans.skew import hot_keys, key_counts, sliced_join

SLICE_LIMIT = 100


@pytest.fixture(scope="module")
def fact(spark):
    """A third of the rows on key 0, a third on null, the rest on 100 keys; all whole."""
    return spark.range(3000).select(
        F.when(F.col("id") < 1000, 0).when(F.col("id") < 2000, None)
        .otherwise(F.col("id") % 100 + 1).cast("bigint").alias("k"),
        F.col("id").alias("v"),
    )


@pytest.fixture(scope="module")
def dim(spark):
    return spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))


def test_hot_keys_are_those_above_the_limit(fact):
    hot = hot_keys(key_counts(fact, "k"), "k", SLICE_LIMIT)
    assert rows(hot) == [(None, 10), (0, 10)]


def test_number_of_hot_keys_is_bounded_by_their_share(fact):
    # No key can own more than a half, so none is hot at max_keys=2, however low min_rows.
    assert hot_keys(key_counts(fact, "k"), "k", 1, max_keys=2).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_sliced_join_equals_the_plain_join(fact, dim, how):
    plain = fact.join(dim, "k", how)
    sliced = sliced_join(fact, dim, "k", how, min_rows=SLICE_LIMIT)
    assert sliced.columns == plain.columns
    assert rows(sliced) == rows(plain)


def test_a_hot_key_is_spread_over_tasks(spark, fact, dim):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sliced = sliced_join(fact, dim, "k", "left", min_rows=SLICE_LIMIT)
        tasks = sliced.withColumn("task", F.spark_partition_id())
        for key in ("k = 0", "k is null"):
            assert tasks.filter(key).select("task").distinct().count() > 1
        plain = fact.join(dim, "k", "left").withColumn("task", F.spark_partition_id())
        assert plain.filter("k = 0").select("task").distinct().count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_without_hot_keys_the_join_is_plain(fact, dim):
    assert "slice" not in plan_of(sliced_join(fact, dim, "k"))
    assert "xxhash64" in plan_of(sliced_join(fact, dim, "k", min_rows=SLICE_LIMIT))


def test_other_join_types_are_refused(fact, dim):
    with pytest.raises(ValueError):
        sliced_join(fact, dim, "k", "full")


def test_empty_fact(fact, dim):
    assert sliced_join(fact.filter("v < 0"), dim, "k", min_rows=1).count() == 0

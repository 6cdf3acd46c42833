import pytest
from support import plan_of, rows
from pyspark.sql import functions as F

from cinefold import catalog
from cinefold.operators import features as U
from cinefold.plans.skew import hot_keys

SF_DIR = "/root/testdata/sf0.001"


def test_a_key_gets_no_more_slices_than_it_may(spark):
    counts = spark.createDataFrame([(1, 1000, 3), (2, 1000, 1), (3, 1000, 90)], "k bigint, rows bigint, most bigint")
    assert rows(hot_keys(counts, "k", 100)) == [(1, 3), (3, 10)]


def test_slices_of_a_user_with_long_arrays_hold_many_ratings(spark):
    features = spark.range(1).select(
        F.col("id").alias("userId"), F.lit(5000).cast("bigint").alias("num_movies"),
        F.sequence(F.lit(1), F.lit(5000)).alias("movie_ids"), F.lit("ab" * 64).alias("text"))
    (key, n, most), = rows(U.output_rows(features))
    assert (key, n, most) == (0, 5000 * (1 + (5000 * U.ELEMENT_BYTES + 128) // U.ROW_BYTES), 5)


def test_wide_table_repeats_what_was_made_of_the_arrays(ratings, movies):
    features = U.user_features(ratings, movies)
    digest = F.md5(F.array_join(F.col("movie_ids").cast("array<string>"), ","))
    first = U.training_table(ratings, features.withColumn("movie_ids", digest).drop("genre_profile"), wide=True)
    after = U.training_table(ratings, features, wide=True).withColumn("movie_ids", digest).drop("genre_profile")
    assert rows(first) == rows(after)


@pytest.mark.parametrize("name", ["training_wide_hot", "training_wide", "training_wide_shares", "latest_user_rows"])
def test_features_are_made_once(spark, name):
    plan = plan_of(catalog.queries()[name](spark, SF_DIR))
    assert "collect_list" not in plan and "lineitem" not in plan
    if name in ("training_wide_hot", "training_wide"):
        assert "array_join" not in plan and "md5" not in plan

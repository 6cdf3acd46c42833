from support import plan_of, rows

from cinefold import catalog
from cinefold.operators import training as T

SF_DIR = "/root/testdata/sf0.001"


def test_parts_follow_the_size_of_the_table(spark):
    plan = plan_of(catalog.queries()["random_split_rows"](spark, SF_DIR))
    assert "REBALANCE" in plan.upper() and "REPARTITION_BY_NUM" not in plan


def test_skipped_rows_come_from_the_sums_of_the_fit(spark):
    ratings = spark.createDataFrame(
        [(1, 1, 4.0, 1), (1, 2, None, 0), (2, 1, None, 0), (2, 2, None, 0), (3, 1, 1.0, 0)],
        "userId bigint, movieId bigint, rating double, target int")
    sums = T.user_sums(ratings)
    assert T.skipped_of(sums) == 2
    assert rows(T.sums_examples(sums)) == rows(T.user_examples(ratings))
    assert T.skipped_of(sums.limit(0)) == 0


def test_features_of_both_splits_come_from_one_written_table(spark):
    made = catalog._split_features(spark, SF_DIR)
    assert "lineitem" not in plan_of(made)
    assert {r.split for r in made.select("split").distinct().collect()} == {"train", "test"}

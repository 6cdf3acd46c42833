"""Label, clean and split ratings; clean movies."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIKED_FROM = 4.0
SEED = 42


def with_target(df: DataFrame, threshold: float = LIKED_FROM) -> DataFrame:
    """Add `target`: 1 from the threshold on, else 0, also for a null rating."""
    return df.withColumn("target", F.when(F.col("rating") >= threshold, 1).otherwise(0))


def drop_null_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows where any of `cols` is null, as predicates a scan can push down."""
    return df.filter(reduce(and_, [F.col(c).isNotNull() for c in cols]))


def clean_ratings(ratings: DataFrame) -> DataFrame:
    """Labelled ratings with a user and a movie; null ratings and timestamps stay."""
    return drop_null_keys(with_target(ratings), ["userId", "movieId"])


def clean_movies(movies: DataFrame) -> DataFrame:
    """Movies with an id and a genre string."""
    return drop_null_keys(movies, ["movieId", "genres"])


def random_split(df: DataFrame, weights: list[float] | None = None,
                 seed: int = SEED) -> list[DataFrame]:
    """Seeded random parts, disjoint and together whole.

    The parts depend on how the input is partitioned; `hash_split` does not.
    """
    return df.randomSplit(weights or [0.8, 0.2], seed=seed)


def split_name(keys: list[str], train_pct: int = 80) -> Column:
    """'train' or 'test' from the row's key columns alone."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.when(F.pmod(draw, F.lit(100)) < train_pct, "train").otherwise("test")


def hash_split(df: DataFrame, keys: list[str] | None = None, train_pct: int = 80) -> DataFrame:
    """Add `split`; equal keys get equal parts, whatever the partitioning or retries.

    One pass and no shuffle: writing the result partitioned by `split` makes both parts.
    """
    return df.withColumn("split", split_name(keys or ["userId", "movieId", "timestamp"], train_pct))


def repeatable_split(df: DataFrame, train_pct: int = 80, seed: int = SEED) -> DataFrame:
    """The rows with a random `split` that neither partitioning nor a retry changes, and that is drawn
    anew for each of several equal rows.

    Equal rows are combined into their number, on the map side too, and each gets that of its
    occurrence in the draw, so nothing is sorted and a row repeated any number of times moves once.
    """
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    rows = counted.withColumn("__occurrence", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
    rows = rows.withColumn("__seed", F.lit(seed))
    return rows.withColumn("split", split_name(["__seed", *df.columns, "__occurrence"], train_pct)).drop(
        "__n", "__occurrence", "__seed")

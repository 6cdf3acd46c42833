"""From user features to the documents of the store, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.functions.genres import profile_map
from cinefold.functions.requests import from_document, to_document


def store_columns(df: DataFrame) -> DataFrame:
    """The six columns a document is made of."""
    return df.select(
        "userId", "avg_rating", "num_movies", "genre_profile", "last_interaction_ts", "movie_ids"
    )


def latest_user_rows(df: DataFrame) -> DataFrame:
    """One row per user. The columns depend on the user alone, so any row serves.

    Equal rows are combined by hash first; dropping duplicates by key alone would sort all
    rows, arrays included, on the map side. The repartition is the shuffle the second step
    needs anyway, and keeps the optimizer from merging the two steps.
    """
    return store_columns(df).distinct().repartition("userId").dropDuplicates(["userId"])


def store_documents(df: DataFrame) -> DataFrame:
    """Key, JSON document and model inputs of each user; `df` has one row per user."""
    record = F.struct(
        F.col("userId").cast("bigint").alias("user_id"),
        F.col("avg_rating").cast("double").alias("avg_rating"),
        F.col("num_movies").cast("bigint").alias("num_movies"),
        profile_map("genre_profile").alias("genre_profile"),
        F.col("last_interaction_ts").cast("bigint").alias("last_interaction_ts"),
        F.col("movie_ids").cast("array<bigint>").alias("movie_ids"),
    )
    return df.select(
        F.col("userId").cast("string").alias("feature_key"),
        to_document(record).alias("document"),
        F.col("avg_rating").cast("double").alias("avg_rating"),
        F.col("num_movies").cast("bigint").alias("num_movies"),
    )


def parse_documents(snapshot: DataFrame) -> DataFrame:
    """The documents of a snapshot as columns beside their key."""
    parsed = snapshot.select("feature_key", from_document("document").alias("d"))
    return parsed.select("feature_key", "d.*")


def feature_keys(snapshot: DataFrame, limit: int | None = None) -> DataFrame:
    """The keys of the store, or any `limit` of them."""
    keys = snapshot.select("feature_key")
    return keys if limit is None else keys.limit(limit)

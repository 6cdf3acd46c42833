"""User features, genre profiles and the training table.

No group here grows with a hot user or movie. Counts and sums combine on the map
side; a hot user's movie ids are made distinct by (user, movie) before they are
gathered; joins of rows to a user or movie go through a measured broadcast or the
sliced join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from cinefold.functions.genres import NO_GENRES, tokens
from cinefold.plans.broadcast import BROADCAST_LIMIT_BYTES, fits_broadcast
from cinefold.plans.skew import MIN_HOT_ROWS, has_hot_keys, sliced_join
from cinefold.session import cut_lineage

SCALARS = ["avg_rating", "num_movies", "last_interaction_ts"]


def movies_fit_broadcast(movies: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    """Whether the movies' genres are small enough to broadcast; one small aggregate."""
    return fits_broadcast(movies, F.octet_length("genres"), limit)


def ratings_with_movies(ratings: DataFrame, movies: DataFrame,
                        broadcast_limit: int = BROADCAST_LIMIT_BYTES,
                        min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Each rating with its movie's columns; ratings of unknown movies drop out."""
    text = [c for c, t in movies.dtypes if t == "string"]
    payload = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text), F.lit(16))
    if fits_broadcast(movies, payload, broadcast_limit):
        return ratings.join(F.broadcast(movies), "movieId")
    return sliced_join(ratings, movies, "movieId", min_rows=min_hot_rows)


def genre_tokens(movies: DataFrame) -> DataFrame:
    """One row per (movie, token); the no-genres placeholder is left out."""
    return (
        movies.select("movieId", F.explode(tokens("genres")).alias("genre"))
        .filter(F.col("genre") != NO_GENRES)
    )


def user_scalars(ratings: DataFrame) -> DataFrame:
    """Mean rating, number of rows and latest timestamp per user; one combined shuffle."""
    return ratings.groupBy("userId").agg(*_scalars())


def _scalars() -> list[Column]:
    return [
        F.try_divide(F.sum("rating"), F.count("rating")).alias("avg_rating"),
        F.count("movieId").alias("num_movies"),
        F.max("timestamp").alias("last_interaction_ts"),
    ]


def user_simple_features(ratings: DataFrame, min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """The scalars of each user, and the distinct movies, ascending, in one scan.

    Both ways below give the same schema and the same sums. Sets gathered per task are merged per
    user. That would send a hot user's sets from every task to one, so if there is such a user (one counting job tells), equal (user, movie)
    rows are combined first: that spreads a user over all tasks and leaves each movie once.
    """
    if not has_hot_keys(ratings, "userId", min_hot_rows):
        return ratings.groupBy("userId").agg(
            *_scalars(), F.sort_array(F.collect_set("movieId")).alias("movie_ids")
        )
    pairs = ratings.groupBy("userId", "movieId").agg(
        F.count("*").alias("n"), F.sum("rating").alias("rating_sum"),
        F.count("rating").alias("n_rated"), F.max("timestamp").alias("last_ts"),
    )
    return pairs.groupBy("userId").agg(
        F.try_divide(F.sum("rating_sum"), F.sum("n_rated")).alias("avg_rating"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_movies"),
        F.max("last_ts").alias("last_interaction_ts"),
        F.sort_array(F.collect_list("movieId")).alias("movie_ids"),
    )


def user_genre_counts(ratings: DataFrame, movies: DataFrame,
                      broadcast_limit: int = BROADCAST_LIMIT_BYTES,
                      min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Rated rows per (user, genre), partitioned by user.

    A user's rows are counted per whole genre string before the strings are cut, so a rating
    moves at most once, and fewer rows are multiplied by their genres. The counts left, no
    more per user than there are genre strings, then move to their user, where cutting and
    counting them, and what callers do by user, needs no further shuffle.

    With movies too large to broadcast, equal (user, movie) rows are counted first, and the
    movies' genres reach them through a shuffle on the movie, hot movies sliced.
    """
    if movies_fit_broadcast(movies, broadcast_limit):
        listed = F.broadcast(movies.select("movieId", "genres"))
        rated = ratings.select("userId", "movieId").join(listed, "movieId")
        n = F.count("*")
    else:
        pairs = ratings.groupBy("userId", "movieId").agg(F.count("*").alias("n"))
        listed = movies.groupBy("movieId", "genres").agg(F.count("*").alias("copies"))
        rated = sliced_join(pairs, listed, "movieId", min_rows=min_hot_rows)
        n = F.sum(F.col("n") * F.col("copies"))
    return (
        rated.groupBy("userId", "genres").agg(n.alias("n"))
        .repartition("userId")
        .select("userId", "n", F.explode(tokens("genres")).alias("genre"))
        .filter(F.col("genre") != NO_GENRES)
        .groupBy("userId", "genre").agg(F.sum("n").alias("genre_count"))
    )


def genre_proportions(genre_counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Each genre's count over the user's number of ratings, known movie or not."""
    return genre_counts.join(totals.select("userId", "num_movies"), "userId").withColumn(
        "proportion", F.col("genre_count") / F.col("num_movies")
    )


def genre_profile(proportions: DataFrame) -> DataFrame:
    """One array of (genre, proportion) per user, by genre."""
    entry = F.struct(
        F.col("genre").cast("string").alias("genre"),
        F.col("proportion").cast("double").alias("proportion"),
    )
    return proportions.groupBy("userId").agg(
        F.sort_array(F.collect_list(entry)).alias("genre_profile")
    )


def user_features(ratings: DataFrame, movies: DataFrame,
                  broadcast_limit: int = BROADCAST_LIMIT_BYTES,
                  min_hot_rows: int = MIN_HOT_ROWS, by: Sequence[str] = ("userId",)) -> DataFrame:
    """All features, one row per user; the profile is null for users without genre rows.

    One scan of the ratings, without a counting job. They are first grouped by user and movie, which
    combines on the map side and spreads a hot user over all tasks, and leaves each movie once: no
    set is ever gathered from raw rows. What is left, at most the distinct movies of a user, moves to
    its user once, and everything after that is local. With a column of parts in `by`, such as
    `split`, the features of all parts come from the same pass.
    """
    pairs = user_movies(ratings, by)
    if movies_fit_broadcast(movies, broadcast_limit):
        listed = F.broadcast(movie_listings(movies, combine=False))
        rated = _at_user(pairs, by).join(listed, "movieId", "left")
    else:
        listed = movie_listings(movies)
        # Counting hot movies for the sliced join would scan the ratings again.
        rated = _at_user(sliced_join(cut_lineage(pairs), listed, "movieId", "left",
                                     min_rows=min_hot_rows), by)
    return merged_features(rated, by)


def _at_user(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows moved to their user. Genres multiply them there, so the number of partitions is
    stated: adaptive execution would merge them by the size they have before."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def user_movies(ratings: DataFrame, by: Sequence[str] = ("userId",)) -> DataFrame:
    """The mergeable state of each user and movie: rows, rated rows, sum and latest timestamp."""
    return ratings.groupBy(*by, "movieId").agg(
        F.count("movieId").alias("n"), F.count("rating").alias("n_rated"),
        F.sum("rating").alias("rating_sum"), F.max("timestamp").alias("last_ts"))


def movie_listings(movies: DataFrame, combine: bool = True) -> DataFrame:
    """The genre strings of each movie, as (genres, copies). Equal strings are combined first, which
    a movie with any number of rows needs; where all movies fit a broadcast, that shuffle is saved."""
    strings, copies = movies, F.lit(1).cast("bigint")
    if combine:
        strings, copies = movies.groupBy("movieId", "genres").agg(F.count("*").alias("n")), F.col("n")
    return strings.groupBy("movieId").agg(
        F.collect_list(F.struct("genres", copies.alias("copies"))).alias("listings"))


def merged_features(rated: DataFrame, by: Sequence[str] = ("userId",)) -> DataFrame:
    """Features from the states of `user_movies` with the movies' listings, partitioned by user.

    A state becomes a row of its own and one row per genre; both are summed in one aggregation, in
    generated code, since arrays are only made from its result.
    """
    none = F.lit(None)
    state = F.struct(none.cast("string").alias("genre"), F.col("movieId"), F.col("n"), F.col("n_rated"),
                     F.col("rating_sum"), F.col("last_ts"))
    per_genre = F.flatten(F.transform("listings", lambda listing: F.transform(
        F.filter(tokens(listing["genres"]), lambda g: g != NO_GENRES),
        lambda g: F.struct(
            g.alias("genre"), none.cast("bigint").alias("movieId"),
            (F.col("n") * listing["copies"]).alias("n"), none.cast("bigint").alias("n_rated"),
            none.cast("double").alias("rating_sum"), none.cast("bigint").alias("last_ts")))))
    rows = rated.select(*by, F.inline(F.concat(
        F.array(state), F.coalesce(per_genre, F.array().cast(_STATES)))))
    sums = rows.groupBy(*by, "genre", "movieId").agg(
        *(F.sum(c).alias(c) for c in ("n", "n_rated", "rating_sum")), F.max("last_ts").alias("last_ts"))
    movie, genre = F.col("genre").isNull(), F.col("genre").isNotNull()
    gathered = sums.groupBy(*by).agg(
        F.try_divide(F.sum("rating_sum"), F.sum("n_rated")).alias("avg_rating"),
        F.coalesce(F.sum(F.when(movie, F.col("n"))), F.lit(0)).alias("num_movies"),
        F.max("last_ts").alias("last_interaction_ts"),
        F.sort_array(F.collect_list("movieId")).alias("movie_ids"),
        F.sort_array(F.collect_list(F.when(genre, F.struct("genre", "n")))).alias("counts"))
    shares = F.transform("counts", lambda c: F.struct(
        c["genre"].alias("genre"), (c["n"] / F.col("num_movies")).alias("proportion")))
    return gathered.select(*by, *SCALARS, "movie_ids",
                           F.when(F.size("counts") > 0, shares).alias("genre_profile"))


_STATES = ("array<struct<genre:string,movieId:bigint,n:bigint,n_rated:bigint,rating_sum:double,"
           "last_ts:bigint>>")


def training_table(ratings: DataFrame, features: DataFrame, wide: bool = False,
                   counts: DataFrame | None = None,
                   min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """One row per cleaned rating with its user's features.

    Narrow, it carries the scalars only. Wide, it also repeats each user's other columns, the arrays
    or what a caller made of them per user, on each of the user's rows. That grows with the square
    of a user's activity: users are then cut into slices by the bytes of their output, as
    `output_rows` counts them. Where the features are a written table, `counts` from
    `rating_counts` saves counting the ratings.
    """
    others = _others(features) if wide else []
    if wide:
        counts = output_rows(features)
    return sliced_join(
        ratings, features.select("userId", *SCALARS, *others), "userId",
        counts=counts, min_rows=min_hot_rows,
    )


# Bytes of a training row without arrays, and of an array element.
ROW_BYTES, ELEMENT_BYTES, ENTRY_BYTES = 64, 8, 32
# A slice of a user's ratings takes a copy of the user's arrays along, so it holds so many ratings
# at least: the copies are a thousandth of the output, however long the arrays.
SLICE_RATINGS = 1_000


def _others(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in ("userId", *SCALARS)]


def _bytes(features: DataFrame, name: str) -> Column:
    kind = features.schema[name].dataType
    if not isinstance(kind, ArrayType):
        return F.octet_length(F.col(name).cast("string"))
    each = ENTRY_BYTES if isinstance(kind.elementType, StructType) else ELEMENT_BYTES
    return F.greatest(F.size(name), F.lit(0)).cast("bigint") * each


def output_rows(features: DataFrame) -> DataFrame:
    """The wide output of each user's ratings, counted in rows of ROW_BYTES, and into how `most`
    slices they may be cut."""
    wide = sum((F.coalesce(_bytes(features, c), F.lit(0)) for c in _others(features)), F.lit(0).cast("bigint"))
    return features.select(
        "userId", (F.col("num_movies") * (1 + F.ceil(wide / ROW_BYTES))).alias("rows"),
        F.ceil(F.col("num_movies") / SLICE_RATINGS).alias("most"))


def rating_counts(features: DataFrame) -> DataFrame:
    """Ratings per user, as the features have them."""
    return features.select("userId", F.col("num_movies").alias("rows"))

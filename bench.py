"""Time the headline queries; print one JSON line.

`value` is the sum of the best times. `compare` times the feature plan against the same features
put together from single operators, and the training table against a plain join of equal output.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold import catalog
from cinefold.operators import features as U
from cinefold.operators import prepare as P
from cinefold.session import scratch_path, session
from cinefold.sources import sample_views as views
from cinefold.sources.tables import read_movies, read_ratings

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# Low enough that the third of all ratings that one user has in the hot table counts as hot.
HOT_ROWS = 50_000
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))

HEADLINE = [
    "clean_ratings", "hash_split", "user_scalars", "user_simple_features", "user_genre_counts",
    "genre_proportions", "genre_profile", "user_features", "training_narrow", "training_wide",
    "hot_user_features", "hot_user_training", "weighted_examples", "store_documents",
    "store_upsert", "store_lookup", "score_pairs", "classification_metrics", "requests_valid",
    "score_requests", "score_requests_small_batch", "latest_predictions",
    "stream_score_requests", "train_logistic", "full_run",
]


def plain_user_features(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """The features by the library's single operators, one after the other."""
    counts = U.ratings_with_movies(ratings, movies).select("userId", "movieId").join(
        U.genre_tokens(movies), "movieId").groupBy("userId", "genre").agg(
        F.count("*").alias("genre_count"))
    scalars = U.user_scalars(ratings)
    sets = ratings.groupBy("userId").agg(F.collect_set("movieId").alias("movie_ids"))
    profile = U.genre_profile(U.genre_proportions(counts, scalars))
    return scalars.join(sets, "userId").join(profile, "userId", "left")


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(name: str, action) -> float:
    """Best of the repeats in seconds; progress goes to stderr."""
    times = []
    for _ in range(REPEATS):
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    best = round(min(times), 3)
    print(f"{name}: {best}", file=sys.stderr, flush=True)
    return best


def comparison(spark: SparkSession) -> dict[str, dict[str, float]]:
    """Seconds of both plans, on ratings and movies read from Parquet."""
    root = scratch_path(spark, "bench")
    for skew, view in (("even", views.sample_ratings), ("hot", views.hot_user_ratings)):
        view(spark, SF_DIR).write.parquet(f"{root}/{skew}")
    views.sample_movies(spark, SF_DIR).write.parquet(f"{root}/movies")
    movies = P.clean_movies(read_movies(spark, f"{root}/movies", "parquet"))
    seconds = {}
    for skew in ("even", "hot"):
        ratings = P.clean_ratings(read_ratings(spark, f"{root}/{skew}"))
        plain = lambda: plain_user_features(ratings, movies)
        ours = lambda: U.user_features(ratings, movies, min_hot_rows=HOT_ROWS)
        seconds[f"user_features_{skew}"] = {
            "plain": timed(f"plain features {skew}", lambda: run(plain())),
            "ours": timed(f"our features {skew}", lambda: run(ours())),
        }
        scalars = U.user_scalars(ratings)
        seconds[f"training_{skew}"] = {
            "plain": timed(f"plain training {skew}", lambda: run(  # noqa: B023
                ratings.join(scalars, "userId"))),
            "ours": timed(f"our training {skew}", lambda: run(  # noqa: B023
                U.training_table(ratings, scalars, min_hot_rows=HOT_ROWS))),
        }
    return seconds


def main() -> None:
    spark = session(
        {
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
        },
        app_name="bench", master=f"local[{CPUS}]",
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = catalog.queries()
    run(queries["user_features"](spark, SF_DIR))
    seconds = {
        name: timed(name, lambda: run(queries[name](spark, SF_DIR)))  # noqa: B023
        for name in HEADLINE
    }
    print(json.dumps({
        "metric": "total time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "compare": comparison(spark),
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

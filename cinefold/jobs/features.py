"""Build user features and the training table of one split."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.jobs.options import job_parser, job_session
from cinefold.jobs.stages import side_by_side
from cinefold.operators.features import rating_counts, training_table, user_features
from cinefold.operators.prepare import clean_movies, clean_ratings
from cinefold.sources.tables import (
    SPLITS,
    read_features,
    read_movies,
    read_ratings,
    write_features,
    write_splits,
)


def build_features(ratings: DataFrame, movies: DataFrame, out_dir: str,
                   wide: bool = False) -> dict[str, str]:
    """Write user_features, then the training table that joins them to the ratings.

    The features are read back from their table, so the join neither recomputes them nor
    depends on the executors that made them.
    """
    out_dir = out_dir.rstrip("/")
    paths = {name: f"{out_dir}/{name}" for name in ("user_features", "training")}
    ratings = clean_ratings(ratings)
    write_features(user_features(ratings, clean_movies(movies)), paths["user_features"])
    features = read_features(ratings.sparkSession, paths["user_features"])
    training = training_table(ratings, features, wide=wide, counts=rating_counts(features))
    write_features(training, paths["training"])
    return paths


def build_split_features(ratings: DataFrame, movies: DataFrame, out_dir: str,
                         wide: bool = False) -> dict[str, dict[str, str]]:
    """The same for all parts of a `split` column; the paths by part. User features come from one
    pass over the ratings, and then the training tables are made side by side."""
    write_split_features(ratings, movies, out_dir)
    side_by_side(ratings.sparkSession, {
        f"training_{name}": partial(write_split_training, ratings, out_dir, name, wide) for name in SPLITS})
    return {name: split_paths(out_dir, name) for name in SPLITS}


def split_paths(out_dir: str, name: str) -> dict[str, str]:
    """Where the tables of one part are."""
    return {table: f"{out_dir.rstrip('/')}/{table}/split={name}" for table in ("user_features", "training")}


def write_split_features(ratings: DataFrame, movies: DataFrame, out_dir: str) -> None:
    """User features of all parts of a `split` column, in one pass over the ratings."""
    features = user_features(clean_ratings(ratings), clean_movies(movies), by=("split", "userId"))
    write_splits(features, f"{out_dir.rstrip('/')}/user_features")


def write_split_training(ratings: DataFrame, out_dir: str, name: str, wide: bool = False) -> None:
    """The training table of one part, whose user features are written."""
    paths = split_paths(out_dir, name)
    features = read_features(ratings.sparkSession, paths["user_features"])
    part = clean_ratings(ratings).filter(F.col("split") == name).drop("split")
    training = training_table(part, features, wide=wide, counts=rating_counts(features))
    write_features(training, paths["training"])


def main(argv: list[str] | None = None) -> None:
    parser = job_parser("Features and training table of one split")
    parser.add_argument("--input_path", required=True, help="ratings of the split, Parquet")
    parser.add_argument("--movies_path", required=True)
    parser.add_argument("--movies_format", default="csv", choices=["csv", "parquet"])
    parser.add_argument("--output_path", required=True)
    parser.add_argument("--wide", action="store_true", help="repeat the arrays on every rating")
    args = parser.parse_args(argv)
    spark = job_session("features", args)
    paths = build_features(
        read_ratings(spark, args.input_path),
        read_movies(spark, args.movies_path, args.movies_format),
        args.output_path, args.wide,
    )
    print(f"features: {paths['user_features']}, training table: {paths['training']}")


if __name__ == "__main__":
    main()

"""The batch jobs in order: split, user features of both splits, then both training tables and the
publishing of test side by side, train."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import partial

from pyspark.sql import SparkSession

from cinefold.jobs.features import split_paths, write_split_features, write_split_training
from cinefold.jobs.options import job_parser, job_session
from cinefold.jobs.split import split_ratings
from cinefold.jobs.stages import Stages, side_by_side
from cinefold.jobs.training import TrainingResult, train_and_register
from cinefold.operators.prepare import clean_ratings
from cinefold.sources.store import publish_features, read_store
from cinefold.sources.tables import SPLITS, read_features, read_movies, read_ratings, read_splits


@dataclass(frozen=True)
class ChainConfig:
    ratings_path: str
    movies_path: str
    out_dir: str
    ratings_format: str = "csv"
    movies_format: str = "csv"
    split_method: str = "hash"
    wide: bool = False
    resume: bool = False

    def path(self, name: str) -> str:
        return f"{self.out_dir.rstrip('/')}/{name}"


def run_pipeline(spark: SparkSession, cfg: ChainConfig) -> TrainingResult:
    """Run every batch job. Only features of the test split are published.

    With `resume`, stages that an earlier run with the same settings completed are left as they
    are; the model is always fitted.
    """
    settings = {k: v for k, v in asdict(cfg).items() if k != "resume"}
    stages = Stages(spark, cfg.path("stages"), settings, cfg.resume)
    splits, features = cfg.path("splits"), cfg.path("features")

    def split() -> None:
        ratings = read_ratings(spark, cfg.ratings_path, cfg.ratings_format)
        split_ratings(ratings, splits, cfg.split_method)

    def build() -> None:
        movies = read_movies(spark, cfg.movies_path, cfg.movies_format)
        write_split_features(read_splits(spark, splits), movies, features)

    def train_table(name: str) -> None:
        write_split_training(read_splits(spark, splits), features, name, cfg.wide)

    def publish() -> None:
        published = read_features(spark, split_paths(features, "test")["user_features"])
        publish_features(published, cfg.path("store"), unique_users=True)

    stages.run("split", split)
    stages.run("user_features", build, needs=("split",))
    after = {f"training_{name}": partial(train_table, name) for name in SPLITS} | {"publish": publish}
    side_by_side(spark, {name: partial(stages.run, name, work, ("user_features",))
                         for name, work in after.items()})
    train, test = (clean_ratings(read_ratings(spark, f"{splits}/split={name}")) for name in ("train", "test"))
    return train_and_register(
        train, test,
        read_store(spark, cfg.path("store")),
        cfg.path("models"), cfg.path("runs"),
    )


def main(argv: list[str] | None = None) -> None:
    parser = job_parser("Run the batch jobs in order")
    parser.add_argument("--ratings_path", required=True)
    parser.add_argument("--movies_path", required=True)
    parser.add_argument("--output_path", required=True)
    parser.add_argument("--ratings_format", default="csv", choices=["csv", "parquet"])
    parser.add_argument("--movies_format", default="csv", choices=["csv", "parquet"])
    parser.add_argument("--split_method", default="hash", choices=["hash", "random", "repeatable"])
    parser.add_argument("--wide", action="store_true")
    parser.add_argument("--resume", action="store_true",
                        help="leave what an earlier run with these options has completed")
    args = parser.parse_args(argv)
    result = run_pipeline(job_session("chain", args), ChainConfig(
        args.ratings_path, args.movies_path, args.output_path, args.ratings_format,
        args.movies_format, args.split_method, args.wide, args.resume,
    ))
    print(f"model version {result.model_version}: {result.metrics}")


if __name__ == "__main__":
    main()

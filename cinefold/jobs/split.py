"""Split the ratings into a train and a test table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cinefold.jobs.options import job_parser, job_session
from cinefold.operators.prepare import hash_split, random_split, repeatable_split
from cinefold.sources.tables import read_ratings, write_split, write_splits


def split_ratings(ratings: DataFrame, out_dir: str, method: str = "hash") -> dict[str, str]:
    """Write both parts and return their paths; a failed write is raised."""
    out_dir = out_dir.rstrip("/")
    paths = {name: f"{out_dir}/split={name}" for name in ("train", "test")}
    if method == "hash":
        write_splits(hash_split(ratings), out_dir)
    elif method == "repeatable":
        write_splits(repeatable_split(ratings), out_dir)
    elif method == "random":
        for part, path in zip(random_split(ratings), paths.values(), strict=True):
            write_split(part, path)
    else:
        raise ValueError(f"unknown split method {method!r}")
    return paths


def main(argv: list[str] | None = None) -> None:
    parser = job_parser("Split ratings 80/20")
    parser.add_argument("--input_path", required=True)
    parser.add_argument("--output_path", required=True)
    parser.add_argument("--format", default="csv", choices=["csv", "parquet"])
    parser.add_argument("--method", default="hash", choices=["hash", "random", "repeatable"])
    args = parser.parse_args(argv)
    spark = job_session("split", args)
    paths = split_ratings(
        read_ratings(spark, args.input_path, args.format), args.output_path, args.method
    )
    print(f"train: {paths['train']}, test: {paths['test']}")


if __name__ == "__main__":
    main()

"""Publish user features to the store."""

from __future__ import annotations

from cinefold.jobs.options import job_parser, job_session
from cinefold.sources.store import publish_features
from cinefold.sources.tables import read_features


def main(argv: list[str] | None = None) -> None:
    parser = job_parser("Publish one document per user")
    parser.add_argument("--input_path", required=True, help="user features, or a wide training table")
    parser.add_argument("--store_path", required=True)
    parser.add_argument("--unique_users", action="store_true",
                        help="the input has one row per user already")
    args = parser.parse_args(argv)
    spark = job_session("publish", args)
    version = publish_features(
        read_features(spark, args.input_path), args.store_path, unique_users=args.unique_users
    )
    print(f"published version {version}")


if __name__ == "__main__":
    main()

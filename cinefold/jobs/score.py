"""Score requests from Kafka or text files."""

from __future__ import annotations

from cinefold.jobs.options import job_parser, job_session
from cinefold.sources.requests import request_stream
from cinefold.streaming.scoring import start_scoring


def main(argv: list[str] | None = None) -> None:
    parser = job_parser("Score a request stream")
    parser.add_argument("--format", default="kafka", choices=["kafka", "text"])
    parser.add_argument("--option", action="append", default=[], metavar="KEY=VALUE",
                        help="source option, repeatable")
    parser.add_argument("--store_path", required=True)
    parser.add_argument("--model_path", required=True)
    parser.add_argument("--model_version", type=int)
    parser.add_argument("--output_path", required=True)
    parser.add_argument("--checkpoint", required=True)
    parser.add_argument("--available_now", action="store_true",
                        help="stop once the requests that exist now are scored")
    args = parser.parse_args(argv)
    spark = job_session("score", args)
    options = dict(o.split("=", 1) for o in args.option)
    start_scoring(
        request_stream(spark, args.format, options), args.store_path, args.model_path,
        args.output_path, args.checkpoint, args.model_version, args.available_now,
        number_lines=args.format == "text",
    ).awaitTermination()


if __name__ == "__main__":
    main()

"""Options that all jobs share."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from cinefold.session import object_store_conf, session, sizing_conf


def job_parser(description: str) -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--data_gb", type=float,
                        help="size of the input, from which the number of partitions follows")
    parser.add_argument("--endpoint", help="address of an S3-compatible object store")
    parser.add_argument("--access_key", default="", help="its key; empty: as the cluster is set up")
    parser.add_argument("--secret_key", default="")
    parser.add_argument("--virtual_host_style", action="store_true",
                        help="buckets are hosts of the endpoint, not parts of the path")
    return parser


def job_conf(args: argparse.Namespace) -> dict[str, str]:
    """Spark settings that follow from the shared options."""
    conf = sizing_conf(int(args.data_gb * 1024**3)) if args.data_gb else {}
    if args.endpoint:
        store = object_store_conf(args.endpoint, args.access_key, args.secret_key,
                                  not args.virtual_host_style)
        conf |= {k: v for k, v in store.items() if v}
    return conf


def job_session(name: str, args: argparse.Namespace) -> SparkSession:
    return session(job_conf(args), app_name=f"cinefold-{name}")

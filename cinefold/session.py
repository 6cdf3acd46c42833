"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Independent stages of a chain run side by side, each in a pool of its own.
    "spark.scheduler.mode": "FAIR",
}


# Bytes one shuffle task should hold, so that it sorts and aggregates in memory.
SHUFFLE_TASK_BYTES = 256 * 1024 * 1024
# More reduce tasks than this cost more in shuffle blocks than smaller tasks save: from 25 TB on
# tasks grow instead, to 1 GB at 100 TB.
MAX_SHUFFLE_PARTITIONS = 100_000


def shuffle_task_bytes(data_bytes: int) -> int:
    """Bytes of a shuffle task in a run over so many bytes of input."""
    return max(SHUFFLE_TASK_BYTES, -(-data_bytes // MAX_SHUFFLE_PARTITIONS))


def sizing_conf(data_bytes: int) -> dict[str, str]:
    """Partition settings for a run over so many bytes of input.

    A task holds `shuffle_task_bytes`, for which executors need memory. Adaptive execution merges
    small shuffle partitions but never adds any, so the number to start from has to grow with the
    data. Beyond 10 TB, scan tasks read 512 MB instead of
    128 MB, which keeps their number in the low hundred thousands at 100 TB.
    """
    partitions = max(200, -(-data_bytes // shuffle_task_bytes(data_bytes)))
    scan_mb = 512 if data_bytes > 10 * 1024**4 else 128
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": f"{scan_mb}m",
    }


def object_store_conf(endpoint: str, access_key: str, secret_key: str,
                      path_style: bool = True) -> dict[str, str]:
    """Settings for an S3-compatible object store, to pass to `session`."""
    return {
        "spark.hadoop.fs.s3a.endpoint": endpoint,
        "spark.hadoop.fs.s3a.access.key": access_key,
        "spark.hadoop.fs.s3a.secret.key": secret_key,
        "spark.hadoop.fs.s3a.path.style.access": str(path_style).lower(),
        "spark.hadoop.fs.s3a.impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
    }


def session(conf: dict[str, str] | None = None, app_name: str = "cinefold",
            master: str | None = None) -> SparkSession:
    """A session with this library's defaults; `conf` overrides and extends them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def settings_kept(spark: SparkSession) -> Iterator[None]:
    """Puts back what `session` overrides in a session that runs already. Settings of the whole
    application, such as the scheduler's mode, are fixed once it has started and are left alone."""
    before = {key: spark.conf.get(key, None) for key in DEFAULTS if spark.conf.isModifiable(key)}
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as `spark.checkpoint.dir` names it.

    Only a local session may fall back to a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    own = tempfile.mkdtemp(prefix="cinefold-")
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the reliable checkpoint folder once and read it from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet to the shared folder and read from there. Unlike a checkpoint,
    each reader loads only the columns it needs."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

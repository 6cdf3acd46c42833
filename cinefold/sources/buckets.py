"""Tables kept in hashed buckets, of which a new version rewrites only those it touches.

Version N writes its buckets under `data/v=N/bucket=K`; all others stay where they are. The table of
the version, `v=N`, names for each bucket that holds rows the version that wrote it, so an older
version still reads, and no file that someone reads is replaced. The number of buckets is fixed by
the first version.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cinefold.sources.versions import commit_version, version_path

# The table of a version has a row per bucket and passes the driver.
MAX_BUCKETS = 1 << 16
_TABLE = "bucket int, version bigint, buckets int"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def version_buckets(spark: SparkSession, root: str, version: int) -> dict:
    """Of a `version`: `buckets`, their number, and `written`, the version that wrote each bucket that
    holds rows."""
    rows = spark.read.schema(_TABLE).parquet(version_path(root, version)).collect()
    return {"version": version, "buckets": rows[0]["buckets"],
            "written": {r["bucket"]: r["version"] for r in rows if r["version"] is not None}}


def open_buckets(spark: SparkSession, root: str, table: dict, schema: StructType,
                 buckets: Collection[int] | None = None) -> DataFrame:
    """The rows of all buckets, or of some."""
    written = {b: v for b, v in table["written"].items() if buckets is None or b in buckets}
    if not written:
        return spark.createDataFrame([], schema)
    paths = [f"{root.rstrip('/')}/data/v={v}/bucket={b}" for b, v in sorted(written.items())]
    return spark.read.schema(schema).parquet(*paths)


def key_buckets(keys: DataFrame, buckets: int, key: str) -> set[int]:
    """The buckets in which the keys of a table would be; one small aggregate."""
    found = keys.filter(F.col(key).isNotNull()).select(
        bucket_of(F.col(key), buckets).alias("bucket")).distinct()
    return {r["bucket"] for r in found.collect()}


def dealt(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """The rows with their bucket, each bucket in one task."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("bucket", bucket_of(F.col(key), buckets)).repartition(
        min(partitions, buckets), "bucket")


def write_buckets(rows: DataFrame, root: str, version: int, table: dict, touched: set[int],
                  key: str) -> None:
    """Write the touched buckets whole, from rows with their bucket, and commit the version as the
    successor of the table's, which fails if that has another by now."""
    spark, root = rows.sparkSession, root.rstrip("/")
    # Bloom filters let a lookup of one key skip the row groups that lack it.
    rows.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy(
        "bucket").parquet(f"{root}/data/v={version}")
    written = table["written"] | dict.fromkeys(touched, version)
    entries = [(b, v, table["buckets"]) for b, v in sorted(written.items())]
    spark.createDataFrame(entries or [(None, None, table["buckets"])], _TABLE).coalesce(1).write.mode(
        "overwrite").parquet(version_path(root, version))
    commit_version(spark, root, version, table["version"])

"""The feature store: keyed documents in hashed buckets, of which a publish rewrites those that hold
one of its keys."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cinefold.operators.documents import latest_user_rows, store_columns, store_documents
from cinefold.operators.lookup import key_bytes as measured_keys
from cinefold.operators.lookup import lookup_features
from cinefold.plans.broadcast import BROADCAST_LIMIT_BYTES
from cinefold.schemas import SNAPSHOT
from cinefold.sources.buckets import (
    MAX_BUCKETS,
    bucket_of,
    dealt,
    key_buckets,
    open_buckets,
    version_buckets,
    write_buckets,
)
from cinefold.sources.versions import TRIES, VersionConflict, latest_version, reserve_version

KEY = "feature_key"
# Documents that a new store puts into a bucket.
BUCKET_DOCUMENTS = 200_000
MIN_BUCKETS = 16
# A lookup of more keys than can be broadcast goes through the buckets in so many rounds at most.
MAX_ROUNDS = 64


def bucket_table(spark: SparkSession, store_dir: str, version: int | None = None) -> dict:
    """The buckets of a version, the newest unless one is named; see `version_buckets`."""
    version = version or latest_version(spark, store_dir)
    if not version:
        raise FileNotFoundError(f"no feature snapshot under {store_dir}")
    return version_buckets(spark, store_dir, version)


def read_store(spark: SparkSession, store_dir: str, version: int | None = None,
               buckets: Collection[int] | None = None, keys: DataFrame | None = None) -> DataFrame:
    """A snapshot, the newest unless a version is named; of all buckets, of some, or of those in
    which a table of keys would be."""
    table = bucket_table(spark, store_dir, version)
    if keys is not None:
        buckets = key_buckets(keys, table["buckets"], KEY)
    return open_buckets(spark, store_dir, table, SNAPSHOT, buckets)


def lookup_published(keys: DataFrame, store_dir: str, key: str = "feature_key",
                     version: int | None = None, key_bytes: int | None = None,
                     broadcast_limit: int = BROADCAST_LIMIT_BYTES,
                     max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """`lookup_features` against a published store, of which only buckets with keys are read.

    Keys that fit a broadcast meet those buckets at once. More keys go through ranges of buckets, each
    range with its own keys, so that the store is read once and never shuffled. Only where that would
    take more than `max_rounds` rounds does the join shuffle both sides. `keys` is read in every
    round, so it should be a written or persisted table. `key_bytes` is their size, where known.
    """
    spark, table = keys.sparkSession, bucket_table(keys.sparkSession, store_dir, version)
    if key_bytes is None:
        key_bytes = measured_keys(keys, key)
    wanted = sorted(key_buckets(keys, table["buckets"], key))
    rounds = max(1, -(-key_bytes // max(broadcast_limit, 1)))
    if rounds > max_rounds:
        return lookup_features(keys, open_buckets(spark, store_dir, table, SNAPSHOT, set(wanted)), key)
    # Hashing is even, but a few buckets may still hold more than their share of the keys.
    rounds = 1 if rounds == 1 else min(2 * rounds, max(1, len(wanted)))
    if rounds == 1:
        return lookup_features(keys, open_buckets(spark, store_dir, table, SNAPSHOT, set(wanted)), key,
                               key_bytes=min(key_bytes, broadcast_limit),
                               broadcast_limit=broadcast_limit)
    # A null key is looked for in no bucket; the first round answers it.
    at = F.when(F.col(key).isNull(), wanted[0]).otherwise(bucket_of(F.col(key), table["buckets"]))
    parts = []
    for k in range(rounds):
        some = set(wanted[k::rounds])
        store = open_buckets(spark, store_dir, table, SNAPSHOT, some)
        parts.append(lookup_features(keys.filter(at.isin(some)), store, key, key_bytes=0,
                                     broadcast_limit=broadcast_limit))
    return reduce(DataFrame.unionByName, parts)


def publish_features(df: DataFrame, store_dir: str, version: int | None = None,
                     unique_users: bool = False,
                     writer: Callable[[Iterator[Row]], None] | None = None,
                     buckets: int | None = None) -> int:
    """Upsert one document per user and return the new version.

    `unique_users` says that `df` already has one row per user, as `user_features` does,
    which saves the deduplication. A `writer` is run once per partition on the documents
    of this publish, for a store outside Spark; partitions may be run again. `buckets` is for the
    first publish; without it, their number follows from the documents.

    Of two publishes at once none is lost: the later one merges its documents into the version of
    the other and wins where both have a key. Only the merge is done again, from the written documents.
    """
    spark, root = df.sparkSession, store_dir.rstrip("/")
    newest = latest_version(spark, root)
    if version and version <= newest:
        raise ValueError(f"version {version} is not above the published {newest}")
    named, version = version, reserve_version(spark, root, newest, version)
    made = store_documents(store_columns(df) if unique_users else latest_user_rows(df))
    # Written once, so that the buckets and the writer get the same documents from one pass.
    delta = f"{root}/deltas/v={version}"
    made.write.mode("overwrite").parquet(delta)
    documents = spark.read.schema(SNAPSHOT).parquet(delta)
    for _ in range(TRIES):
        newest = latest_version(spark, root)
        if version <= newest:
            if named:
                raise VersionConflict(f"version {newest} was published before {named} was ready")
            version = reserve_version(spark, root, newest)
        try:
            _merge_into(spark, root, newest, documents, version, buckets)
            break
        except VersionConflict:
            continue
    else:
        raise VersionConflict(f"{TRIES} other publishes to {root} came first")
    if writer is not None:
        documents.foreachPartition(writer)
    return version


def _merge_into(spark: SparkSession, root: str, newest: int, documents: DataFrame, version: int,
                buckets: int | None) -> None:
    """Commit a version that holds the documents and, of the newest, all others."""
    if newest:
        table = bucket_table(spark, root, newest)
    else:
        table = {"version": 0, "written": {}, "buckets": buckets or min(MAX_BUCKETS, max(
            MIN_BUCKETS, -(-documents.count() // BUCKET_DOCUMENTS)))}
    touched = key_buckets(documents, table["buckets"], KEY)
    merged = new = dealt(documents, KEY, table["buckets"])
    if touched & table["written"].keys():
        # Both sides are dealt by bucket, so neither the join nor the write moves them again.
        old = dealt(open_buckets(spark, root, table, SNAPSHOT, touched), KEY, table["buckets"])
        kept = old.join(new.select("bucket", KEY), ["bucket", KEY], "left_anti")
        merged = kept.unionByName(new)
    write_buckets(merged, root, version, table, touched, KEY)

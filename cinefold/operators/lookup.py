"""Look up published features by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.functions.linear import FEATURES
from cinefold.plans.broadcast import BROADCAST_LIMIT_BYTES, measured_bytes
from cinefold.plans.skew import MIN_HOT_ROWS, sliced_join


def key_bytes(keys: DataFrame, key: str = "feature_key") -> int:
    """Bytes that all keys of a batch would take in a broadcast; one aggregate."""
    return measured_bytes(keys, F.octet_length(key))


def lookup_features(keys: DataFrame, store: DataFrame, key: str = "feature_key",
                    key_bytes: int | None = None, min_hot_rows: int = MIN_HOT_ROWS,
                    broadcast_limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Every row of `keys` with the stored model inputs of its key.

    `found` tells a key that is absent from one that is stored with null inputs. Any number
    of rows may share a key. `key_bytes` is the measured size of the keys, where known: up to
    `broadcast_limit`, the store is first cut down to the keys by a broadcast, and is never
    shuffled. Beyond, or unmeasured, the join shuffles and slices hot keys.
    """
    wanted = store.select(
        F.col("feature_key").alias(key), *FEATURES, F.lit(True).alias("__found")
    )
    if key_bytes is not None and key_bytes <= broadcast_limit:
        present = F.broadcast(keys.filter(F.col(key).isNotNull()).select(key).distinct())
        wanted = F.broadcast(wanted.join(present, key, "left_semi"))
        joined = keys.join(wanted, key, "left")
    else:
        joined = sliced_join(keys, wanted, key, "left", min_rows=min_hot_rows)
    return joined.withColumn("found", F.coalesce("__found", F.lit(False))).drop("__found")


def split_hits(looked_up: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is stored, and rows whose key is not."""
    return looked_up.filter("found").drop("found"), looked_up.filter(~F.col("found")).drop("found")


def missing_keys(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """Validation pairs of users that the store does not hold."""
    keyed = pairs.withColumn("feature_key", F.col("userId").cast("string"))
    return keyed.join(store.select("feature_key"), "feature_key", "left_anti").select(*pairs.columns)

"""An equi-join that measures its keys and cuts the hot ones into slices.

A key may own a third of all rows. Hashing on the key alone would put them in one
task, so the rows of such a key are spread over `slices` sub-keys, and the one
matching row of the other side is repeated once per slice. All other keys have a
single slice. Where no key is hot, the join is a plain one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# A key with fewer rows than this is never worth slicing.
MIN_HOT_ROWS = 1_000_000
# No more keys than this can be hot: each owns over 1/MAX_HOT_KEYS of all rows, which is more
# than an even share of the most shuffle tasks a run may have.
MAX_HOT_KEYS = 100_000

_SLICE = "__slice"


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per key, null included, as (key, rows); one row per key and task is moved."""
    return df.groupBy(key).agg(F.count("*").alias("rows"))


def hot_keys(counts: DataFrame, key: str, min_rows: int = MIN_HOT_ROWS,
             max_keys: int = MAX_HOT_KEYS) -> DataFrame:
    """The keys to slice, as (key, slices), from (key, rows).

    A hot key has more than total/max_keys rows, so there are fewer than max_keys of
    them, and their slices together number at most twice max_keys. Where `counts` has a third
    column `most`, a key gets no more slices than that.
    """
    total = counts.agg(F.sum("rows")).scalar()
    limit = F.greatest(F.lit(min_rows), F.ceil(total / F.lit(max_keys)))
    slices = F.ceil(F.col("rows") / limit)
    if "most" in counts.columns:
        slices = F.least(slices, F.col("most"))
    return counts.filter(F.col("rows") > limit).select(key, slices.alias("slices")).filter("slices > 1")


def has_hot_keys(df: DataFrame, key: str, min_rows: int = MIN_HOT_ROWS,
                 max_keys: int = MAX_HOT_KEYS) -> bool:
    """Whether some key of `df` is hot; one job over the key column."""
    return not hot_keys(key_counts(df, key), key, min_rows, max_keys).isEmpty()


def sliced_join(fact: DataFrame, dim: DataFrame, key: str, how: str = "inner",
                counts: DataFrame | None = None, min_rows: int = MIN_HOT_ROWS,
                max_keys: int = MAX_HOT_KEYS) -> DataFrame:
    """Join `fact` to `dim` on `key`, `how` being inner or left.

    Runs one job to find the hot keys, from `counts` as (key, rows) where the caller has
    them, else from the key column of `fact`. At most `max_keys` rows come back from it.

    The slice of a row depends on its content alone, so a task that is run again puts it
    in the same place. Null keys match nothing; where hot, they are spread by content too.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"sliced_join cannot do a {how} join")
    found = hot_keys(counts if counts is not None else key_counts(fact, key), key,
                     min_rows, max_keys).collect()
    if not found:
        return fact.join(dim, key, how)

    spark = fact.sparkSession
    schema = fact.select(key).schema.add("slices", LongType())
    hot = F.broadcast(spark.createDataFrame([r for r in found if r[key] is not None], schema))
    one = F.lit(1).cast("bigint")
    content = F.xxhash64(*[F.col(c) for c in fact.columns])
    null_slices = next((r["slices"] for r in found if r[key] is None), 1)
    slices = F.when(F.col(key).isNull(), F.lit(null_slices)).otherwise(
        F.coalesce(F.col("slices"), one)
    )
    sliced_fact = fact.join(hot, key, "left").withColumn(
        _SLICE, F.pmod(content, slices)
    ).drop("slices")
    sliced_dim = dim.join(hot, key, "left").withColumn(
        _SLICE, F.explode(F.sequence(one - 1, F.coalesce(F.col("slices"), one) - 1))
    ).drop("slices")
    return sliced_fact.join(sliced_dim, [key, _SLICE], how).drop(_SLICE)

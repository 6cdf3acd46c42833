"""The log of request outcomes, and the latest prediction per request kept from it.

A micro-batch is written to a directory of its own attempt, `data/batch_id=N/attempt=K`, and only
then named in the commit log. A reader takes the last committed attempt of each batch, so it never
sees a part of one, and no file that someone reads is replaced. One writer at a time.

The commit log has a file per attempt, in a directory per era of `ERA` batches. A compaction folds
all eras that are over into one table, a version of `folded`; a reader takes the newest of those and
the eras since, so it opens a bounded number of files, however long the stream has run.

`compact_predictions` keeps the latest predictions in `BUCKETS` hashed buckets, as a version of
`latest`; a version is the last batch in it, and rewrites only the buckets with requests of its
batches. A lookup reads one bucket and the batches since. The stream starts it every `COMPACT_EVERY`
batches.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cinefold.operators.scoring import (
    latest_rows,
    published_predictions,
    rejects,
    scored_rows,
)
from cinefold.plans.broadcast import fits_broadcast
from cinefold.schemas import LATEST, OUTCOMES
from cinefold.sources.buckets import (
    bucket_of,
    dealt,
    key_buckets,
    open_buckets,
    version_buckets,
    write_buckets,
)
from cinefold.sources.versions import commit_version, latest_version, version_path

BUCKETS = 256
# Batches whose commits share a directory, and between two compactions of a stream.
ERA = 100
COMPACT_EVERY = 100
KEY = "request_id"
_COMMIT = "batch_id bigint, attempt bigint"


def _found(spark: SparkSession, schema: str | StructType, path: str) -> DataFrame | None:
    """A table, or nothing if it has not been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _read(spark: SparkSession, schema: str | StructType, path: str) -> DataFrame:
    found = _found(spark, schema, path)
    return spark.createDataFrame([], schema) if found is None else found


def _era(out_dir: str, era: int) -> str:
    return f"{out_dir.rstrip('/')}/commits/era={era}"


def _commits(spark: SparkSession, out_dir: str, after: int = -1) -> DataFrame:
    """The valid attempt of each batch after one."""
    root = out_dir.rstrip("/")
    # Folded table N holds the eras before N. Era N exists as long as a batch is in it, so the first
    # one that is missing ends the log; a compaction leaves at most a few.
    folded = latest_version(spark, f"{root}/folded")
    found = spark.createDataFrame([], _COMMIT)
    if folded and after < folded * ERA - 1:
        found = spark.read.schema(_COMMIT).parquet(version_path(f"{root}/folded", folded))
    era = max(folded, (after + 1) // ERA)
    while (rows := _found(spark, _COMMIT, _era(root, era))) is not None:
        found, era = found.unionByName(rows), era + 1
    return found.filter(F.col("batch_id") > after).groupBy("batch_id").agg(
        F.max("attempt").alias("attempt"))


def _check_no_gap(spark: SparkSession, root: str, era: int) -> None:
    """A reader stops at the first era without a batch, so none may be left out."""
    if era > latest_version(spark, f"{root}/folded") and _found(spark, _COMMIT, _era(root, era - 1)) is None:
        raise ValueError(f"no batch from {(era - 1) * ERA} to {era * ERA - 1} was ever written")


def fold_commits(spark: SparkSession, out_dir: str, last: int) -> int:
    """Fold the commits of all eras before that of batch `last`, which may still be run again; the
    number of eras that are folded now."""
    root, eras = f"{out_dir.rstrip('/')}/folded", last // ERA
    if eras > latest_version(spark, root):
        _commits(spark, out_dir).filter(F.col("batch_id") < eras * ERA).coalesce(1).write.mode(
            "overwrite").parquet(version_path(root, eras))
        commit_version(spark, root, eras)
    return eras


def write_outcomes(outcomes: DataFrame, out_dir: str, batch_id: int) -> None:
    """Write scored and rejected rows of a batch in one pass, then commit them.

    A batch that is run again becomes another attempt, which replaces the one before.
    """
    spark, root = outcomes.sparkSession, out_dir.rstrip("/")
    era, attempt = _era(root, batch_id // ERA), 0
    commits = _found(spark, _COMMIT, era)
    if commits is None:
        _check_no_gap(spark, root, batch_id // ERA)
    else:
        done = commits.filter(F.col("batch_id") == batch_id).agg(F.max("attempt").alias("a")).first()["a"]
        attempt = 0 if done is None else done + 1
    outcomes.write.mode("overwrite").partitionBy("outcome").parquet(
        f"{root}/data/batch_id={batch_id}/attempt={attempt}")
    spark.createDataFrame([(batch_id, attempt)], _COMMIT).coalesce(1).write.mode("append").parquet(era)


def read_outcomes(spark: SparkSession, out_dir: str, after: int | None = None) -> DataFrame:
    """All committed outcomes, or those of the batches after one; no rows before the first."""
    root = out_dir.rstrip("/")
    log = _read(spark, OUTCOMES, f"{root}/data")
    commits = _commits(spark, root, -1 if after is None else after)
    if after is not None:
        log = log.filter(F.col("batch_id") > after)
    # A row per micro-batch: where they fit, a small table that prunes the directories read.
    if fits_broadcast(commits, F.lit(16)):
        commits = F.broadcast(commits)
    return log.join(commits, ["batch_id", "attempt"], "left_semi").drop("attempt")


def read_predictions(spark: SparkSession, out_dir: str) -> DataFrame:
    """Every prediction made, with its batch; see `read_latest` for the last ones."""
    return scored_rows(read_outcomes(spark, out_dir))


def read_rejects(spark: SparkSession, out_dir: str) -> DataFrame:
    return rejects(read_outcomes(spark, out_dir))


def _latest(out_dir: str) -> str:
    return f"{out_dir.rstrip('/')}/latest"


def _kept(spark: SparkSession, out_dir: str) -> tuple[dict, int]:
    """The buckets of the newest compacted table and its last batch, -1 before the first one."""
    version = latest_version(spark, _latest(out_dir))
    if not version:
        return {"version": 0, "buckets": BUCKETS, "written": {}}, -1
    # The version is the last batch and one, as batches count from 0 and versions from 1.
    return version_buckets(spark, _latest(out_dir), version), version - 1


def _merged(kept: DataFrame, newer: DataFrame) -> DataFrame:
    newer = newer.select("request_id", "feature_key", "prediction", "processed_at", "arrival",
                         "batch_id")
    return latest_rows(kept.unionByName(newer))


def compact_predictions(spark: SparkSession, out_dir: str) -> int:
    """Merge all committed batches into the kept buckets, of which only those with requests of the
    newer batches are rewritten, and fold the commits; returns the last batch in it."""
    table, last = _kept(spark, out_dir)
    newest = _commits(spark, out_dir, last).agg(F.max("batch_id").alias("b")).first()["b"]
    if newest is None:
        return last
    newer = scored_rows(read_outcomes(spark, out_dir, last)).filter(F.col("batch_id") <= newest)
    touched = key_buckets(newer, table["buckets"], KEY)
    kept = open_buckets(spark, _latest(out_dir), table, LATEST, touched)
    write_buckets(dealt(_merged(kept, newer), KEY, table["buckets"]), _latest(out_dir), newest + 1,
                  table, touched, KEY)
    fold_commits(spark, out_dir, newest)
    return newest


def read_latest(spark: SparkSession, out_dir: str) -> DataFrame:
    """The latest prediction of every request, compacted or not."""
    table, last = _kept(spark, out_dir)
    kept = open_buckets(spark, _latest(out_dir), table, LATEST)
    return published_predictions(_merged(kept, scored_rows(read_outcomes(spark, out_dir, last))))


def read_prediction(spark: SparkSession, out_dir: str, request_id: str) -> DataFrame:
    """The latest prediction of one request, or no row; reads one bucket and the newer batches."""
    table, last = _kept(spark, out_dir)
    wanted = F.col("request_id") == request_id
    bucket = spark.range(1).select(bucket_of(F.lit(request_id), table["buckets"]).alias("b")).first()["b"]
    kept = open_buckets(spark, _latest(out_dir), table, LATEST, {bucket}).filter(wanted)
    newer = scored_rows(read_outcomes(spark, out_dir, last)).filter(wanted)
    return published_predictions(_merged(kept, newer))


def write_predictions(batch_df: DataFrame, batch_id: int, out_dir: str) -> None:
    """Sink for scored rows alone."""
    write_outcomes(
        batch_df.withColumn("reason", F.lit(None).cast("string"))
        .withColumn("outcome", F.lit("scored")),
        out_dir, batch_id,
    )

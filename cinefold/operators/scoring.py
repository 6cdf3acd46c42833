"""Parse requests, look up features, predict, and keep the latest prediction."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.functions.linear import LinearScorer, scorer_from
from cinefold.functions.requests import is_blank, request_pair, request_record, to_document
from cinefold.operators.lookup import lookup_features
from cinefold.plans.broadcast import BROADCAST_LIMIT_BYTES
from cinefold.plans.skew import MIN_HOT_ROWS
from cinefold.session import cut_lineage

MALFORMED = "malformed"
MISSING_FIELD = "missing_field"
UNKNOWN_KEY = "unknown_key"
PREDICT_ERROR = "predict_error"
KEY_PREFIX = "prediction_"


def parse_requests(df: DataFrame) -> DataFrame:
    """Requests with request_id, feature_key and `reason`, which is null if valid.

    `df` has columns arrival and value. The fields of an invalid request are null.
    """
    # Exploding an array of one keeps the parse below any filter on its results; a filter
    # pushed through a plain column would repeat the parse for each field it tests.
    pairs = df.select(
        "arrival", "value", F.explode(F.array(request_pair(F.col("value")))).alias("__pair")
    )
    parsed = pairs.withColumn("__r", request_record(F.col("__pair")))
    rid, key = F.col("__r.request_id"), F.col("__r.feature_key")
    reason = (
        F.when(F.col("__r").isNull(), MALFORMED)
        .when(is_blank(rid, F.col("value"), "request_id")
              | is_blank(key, F.col("value"), "feature_key"), MISSING_FIELD)
    )
    return parsed.withColumn("reason", reason).select(
        "arrival", "value",
        F.when(F.col("reason").isNull(), rid).alias("request_id"),
        F.when(F.col("reason").isNull(), key).alias("feature_key"),
        "reason",
    )


def valid_requests(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).drop("reason")


def score_batch(df: DataFrame, store: DataFrame, model: PipelineModel | LinearScorer,
                min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """What becomes of each request, one row per row of `df`.

    The parsed requests go to the checkpoint folder once, as the lookup reads them twice.
    """
    return score_parsed(cut_lineage(parse_requests(df)), store, model, min_hot_rows=min_hot_rows)


def score_parsed(parsed: DataFrame, store: DataFrame, model: PipelineModel | LinearScorer,
                 key_bytes: int | None = None, min_hot_rows: int = MIN_HOT_ROWS,
                 broadcast_limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """What becomes of each parsed request, one row each.

    `key_bytes` is the size of their keys, if it was measured; see `lookup_features`.

    A scored request has a prediction and the time of processing; a rejected one has a
    reason. A row that cannot be scored never fails the others.
    """
    looked_up = lookup_features(parsed, store, key_bytes=key_bytes, min_hot_rows=min_hot_rows,
                                broadcast_limit=broadcast_limit)
    prediction = scorer_from(model).predict()
    scored = looked_up.withColumn("prediction", F.when(F.col("found"), prediction))
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(~F.col("found"), UNKNOWN_KEY)
        .when(F.col("prediction").isNull(), PREDICT_ERROR)
    )
    return scored.withColumn("reason", reason).select(
        "arrival", "value", "request_id", "feature_key", "prediction",
        F.when(F.col("reason").isNull(), F.unix_timestamp(F.current_timestamp()))
        .alias("processed_at"),
        "reason",
        F.when(F.col("reason").isNull(), "scored").otherwise("rejected").alias("outcome"),
    )


def score_requests(df: DataFrame, store: DataFrame,
                   model: PipelineModel | LinearScorer, **options) -> DataFrame:
    """The scored requests alone."""
    return scored_rows(score_batch(df, store, model, **options))


def scored_rows(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("outcome") == "scored").drop("reason", "outcome")


def rejects(outcomes: DataFrame) -> DataFrame:
    """The rejected requests with their reason."""
    kept = [c for c in ("batch_id", "arrival", "value", "reason") if c in outcomes.columns]
    return outcomes.filter(F.col("outcome") == "rejected").select(*kept)


def prediction_records(scored: DataFrame) -> DataFrame:
    """Key and JSON record of each prediction, as a key-value store would hold them."""
    return scored.select(
        F.concat(F.lit(KEY_PREFIX), F.col("request_id")).alias("key"),
        to_document(
            F.struct("request_id", "feature_key", "prediction", "processed_at")
        ).alias("record"),
    )


def latest_rows(log: DataFrame) -> DataFrame:
    """The last prediction per request id, with its place in the source.

    Within one partition or file of the source its own order holds, whatever the times say: by
    batch and sequence. Only what different ones sent is put in order by batch and time. Both
    maxima combine on the map side, so a request id repeated any number of times costs one row
    per task.
    """
    batch = F.col("batch_id") if "batch_id" in log.columns else F.lit(0)
    kept = F.struct("feature_key", "prediction", "processed_at", "arrival", batch.alias("batch_id"))
    per_source = log.groupBy("request_id", "arrival.source", "arrival.block").agg(
        F.max_by(kept, F.struct(batch, "arrival.seq", "arrival.at")).alias("last"))
    last = F.max_by("last", F.struct("last.batch_id", "last.arrival.at", "source", "block"))
    return (
        per_source.groupBy("request_id").agg(last.alias("last"))
        .select("request_id", "last.*")
    )


def latest_predictions(log: DataFrame) -> DataFrame:
    """The last prediction per request id, as a reader gets it."""
    return published_predictions(latest_rows(log))


def published_predictions(latest: DataFrame) -> DataFrame:
    return latest.select("request_id", "feature_key", "prediction", "processed_at")


def prediction_for(log: DataFrame, request_id: str) -> DataFrame:
    """The latest prediction of one request; the filter reaches the scan."""
    return latest_predictions(log.filter(F.col("request_id") == request_id))


def make_requests(keys: DataFrame) -> DataFrame:
    """A request with a fresh id for each key, as JSON text."""
    return keys.select(
        F.to_json(F.struct(F.uuid().alias("request_id"), F.col("feature_key"))).alias("value")
    )

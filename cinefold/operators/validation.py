"""Validate a model on (user, label) pairs against the published features."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinefold.functions import metrics as M
from cinefold.functions.linear import FEATURES, LinearScorer, scorer_from

METRICS = ("accuracy", "roc_auc", "precision", "recall", "f1_score")


def validation_pairs(df: DataFrame) -> DataFrame:
    """The distinct (userId, target) pairs: at most two rows per user."""
    return df.select("userId", "target").distinct()


def validate(model: PipelineModel | LinearScorer, pairs: DataFrame,
             store: DataFrame) -> DataFrame:
    """Each pair with `found` and `prediction`, which is null if not found or not scorable.

    Both sides hold a key at most twice, so a plain equi-join has no hot key.
    """
    wanted = store.select("feature_key", *FEATURES, F.lit(True).alias("__found"))
    keyed = pairs.withColumn("feature_key", F.col("userId").cast("string"))
    return keyed.join(wanted, "feature_key", "left").select(
        "userId", "target", "feature_key", F.coalesce("__found", F.lit(False)).alias("found"),
        scorer_from(model).predict().alias("prediction"),
    )


def confusion(df: DataFrame, *also: Column) -> DataFrame:
    """One row of true and false positives and negatives; unscored rows count nowhere.

    Aggregates in `also` are added to the row.
    """

    def cell(target: int, prediction: int) -> Column:
        hit = (F.col("target") == target) & (F.col("prediction") == prediction)
        return F.coalesce(F.sum(F.when(hit, 1)), F.lit(0)).cast("bigint")

    return df.agg(
        cell(1, 1).alias("tp"), cell(0, 1).alias("fp"),
        cell(0, 0).alias("tn"), cell(1, 0).alias("fn"), *also,
    )


def metrics_of(counts: DataFrame, *also: str) -> DataFrame:
    """The five metrics from a row of confusion counts, and the columns in `also`."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        M.accuracy(tp, fp, tn, fn).alias("accuracy"),
        M.roc_auc(tp, fp, tn, fn).alias("roc_auc"),
        M.precision(tp, fp).alias("precision"),
        M.recall(tp, fn).alias("recall"),
        M.f1_score(tp, fp, fn).alias("f1_score"),
        *also,
    )


def classification_metrics(df: DataFrame) -> DataFrame:
    """Accuracy, ROC-AUC on the 0/1 predictions, precision, recall and F1 in one pass."""
    return metrics_of(confusion(df))

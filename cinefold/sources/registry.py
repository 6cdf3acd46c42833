"""Fitted models by version, and the log of training runs."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from cinefold.schemas import RUNS
from cinefold.sources.versions import (
    TRIES,
    VersionConflict,
    commit_version,
    latest_version,
    reserve_version,
    version_path,
)


def register_model(model: PipelineModel, model_dir: str) -> int:
    """Save a model as the next version, after those that others registered meanwhile."""
    spark, version = SparkSession.active(), 0
    for _ in range(TRIES):
        newest = latest_version(spark, model_dir)
        if version <= newest:
            version = reserve_version(spark, model_dir, newest)
            model.write().overwrite().save(version_path(model_dir, version))
        try:
            commit_version(spark, model_dir, version, newest)
            return version
        except VersionConflict:
            continue
    raise VersionConflict(f"{TRIES} other models came first under {model_dir}")


def load_model(model_dir: str, version: int) -> PipelineModel:
    return PipelineModel.load(version_path(model_dir, version))


def load_latest_model(model_dir: str) -> PipelineModel:
    """The model of the highest complete version."""
    version = latest_version(SparkSession.active(), model_dir)
    if not version:
        raise FileNotFoundError(f"no model under {model_dir}")
    return load_model(model_dir, version)


def log_run(spark: SparkSession, run_dir: str, run_id: str, params: dict[str, str],
            metrics: dict[str, float | None]) -> None:
    """Add one run with its parameters and metrics, in a folder of its own, so that runs that end at
    the same time do not clear each other's unfinished files."""
    spark.createDataFrame([(run_id, params, metrics)], RUNS).coalesce(1).write.mode(
        "append"
    ).parquet(f"{run_dir.rstrip('/')}/{uuid.uuid4().hex}")


def read_runs(spark: SparkSession, run_dir: str) -> DataFrame:
    return spark.read.schema(RUNS).option("recursiveFileLookup", "true").parquet(run_dir)

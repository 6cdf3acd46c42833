"""Train, validate, log and register a model."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.jobs.options import job_parser, job_session
from cinefold.operators.training import (
    Optimality,
    fit_logistic,
    model_inputs,
    model_params,
    skipped_of,
    sums_examples,
    user_sums,
)
from cinefold.operators.validation import METRICS, confusion, metrics_of, validate, validation_pairs
from cinefold.session import cut_lineage
from cinefold.sources.registry import log_run, register_model
from cinefold.sources.store import read_store
from cinefold.sources.tables import read_features


@dataclass(frozen=True)
class TrainingResult:
    run_id: str
    model_version: int
    metrics: dict[str, float | None]
    missing: int
    unscored: int
    skipped: int
    reached: Optimality


def train_and_register(train: DataFrame, test: DataFrame, store: DataFrame, model_dir: str,
                       run_dir: str, run_id: str | None = None) -> TrainingResult:
    """Fit on `train`, validate the pairs of `test` through the store, log, register.

    Both may be training tables or labelled ratings; the latter are read without any join.

    Any failure is raised, a fit short of its minimum too; a model is registered only after it was
    validated and logged. The run log holds the gradient at the fit beside the metrics.
    """
    spark = train.sparkSession
    run_id = run_id or uuid.uuid4().hex
    if "avg_rating" in train.columns:
        skipped, inputs = train.filter("avg_rating IS NULL").count(), model_inputs(train)
    else:
        # Read once: the fit and the count of what it leaves out both need sums per user only.
        sums = cut_lineage(user_sums(train))
        skipped, inputs = skipped_of(sums), sums_examples(sums)
    model, reached = fit_logistic(inputs)
    checked = validate(model, validation_pairs(test), store)
    # One pass: the four confusion counts, and the pairs that could not be scored.
    absent = ~F.col("found")
    summary = metrics_of(
        confusion(
            checked, F.count_if(absent).alias("missing"),
            F.count_if(~absent & F.col("prediction").isNull()).alias("unscored"),
        ),
        "missing", "unscored",
    ).first()
    metrics = {name: summary[name] for name in METRICS}
    log_run(spark, run_dir, run_id, model_params(model) | {"skippedRows": str(skipped)},
            metrics | reached.metrics())
    version = register_model(model, model_dir)
    return TrainingResult(run_id, version, metrics, summary["missing"], summary["unscored"], skipped,
                          reached)


def main(argv: list[str] | None = None) -> None:
    parser = job_parser("Train, validate and register the model")
    parser.add_argument("--train_path", required=True, help="training table of the train split")
    parser.add_argument("--test_path", required=True, help="training table of the test split")
    parser.add_argument("--store_path", required=True, help="feature store root")
    parser.add_argument("--model_path", required=True, help="model registry root")
    parser.add_argument("--run_path", required=True, help="run log")
    args = parser.parse_args(argv)
    spark = job_session("training", args)
    result = train_and_register(
        read_features(spark, args.train_path), read_features(spark, args.test_path),
        read_store(spark, args.store_path), args.model_path, args.run_path,
    )
    print(f"run {result.run_id}: model version {result.model_version}, {result.metrics}, "
          f"{result.missing} pairs not in the store, {result.unscored} without inputs, "
          f"{result.skipped} training rows skipped, {result.reached}")


if __name__ == "__main__":
    main()

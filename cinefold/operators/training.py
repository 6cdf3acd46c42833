"""Fit the logistic model with Spark ML."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinefold.functions.linear import FEATURES, scorer_from
from cinefold.session import cut_lineage

# Mean loss above its minimum at which a fit still counts as finished.
LOSS_GAP = 1e-6


def assembler() -> VectorAssembler:
    """The feature vector in its fixed order; rows with a null input are skipped."""
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="skip")


def model_inputs(df: DataFrame) -> DataFrame:
    """The columns training reads."""
    return df.select(*FEATURES, "target")


def weighted_examples(df: DataFrame) -> DataFrame:
    """Equal training rows as one row with their number as `weight`.

    A user's ratings share their features, so this leaves at most two rows per user. The
    loss of the weighted rows is that of the rows they stand for. Null inputs drop out.
    """
    present = df.filter(F.col("avg_rating").isNotNull() & F.col("num_movies").isNotNull())
    return model_inputs(present).groupBy(*FEATURES, "target").agg(
        F.count("*").cast("double").alias("weight")
    )


def user_examples(ratings: DataFrame) -> DataFrame:
    """The same weighted rows from labelled ratings alone, without joining features to them."""
    return sums_examples(user_sums(ratings))


def user_sums(ratings: DataFrame) -> DataFrame:
    """A user's inputs, `positive` ratings and `rows`, from one pass over labelled ratings."""
    return ratings.groupBy("userId").agg(
        *user_inputs(), F.sum("target").alias("positive"), F.count("*").alias("rows"))


def sums_examples(sums: DataFrame) -> DataFrame:
    """The weighted rows of `user_sums`: of each user one for the positive ratings and one for the others."""
    kept = sums.filter("avg_rating IS NOT NULL").select(*FEATURES, F.inline(F.array(
        F.struct(F.lit(1).alias("target"), F.col("positive").cast("double").alias("weight")),
        F.struct(F.lit(0).alias("target"),
                 (F.col("rows") - F.col("positive")).cast("double").alias("weight")))))
    return kept.filter("weight > 0").groupBy(*FEATURES, "target").agg(F.sum("weight").alias("weight"))


def skipped_of(sums: DataFrame) -> int:
    """Ratings of `user_sums` that training leaves out, their user having no rating value."""
    return sums.filter("avg_rating IS NULL").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def user_inputs() -> list[Column]:
    return [F.try_divide(F.sum("rating"), F.count("rating")).alias("avg_rating"),
            F.count("movieId").alias("num_movies")]


def examples_of(df: DataFrame) -> DataFrame:
    """Weighted rows of a training table, or of labelled ratings."""
    if "weight" in df.columns:
        return df
    return weighted_examples(df) if "avg_rating" in df.columns else user_examples(df)


class NotConverged(RuntimeError):
    """The solver stopped before it reached the minimum."""


@dataclass(frozen=True)
class Optimality:
    """How far a fit is from the minimum: the norm of its gradient per row, the mean loss that a
    Newton step from it would still gain, and the largest change of a coefficient in that step."""

    gradient_norm: float
    loss_gap: float
    newton_step: float

    def metrics(self) -> dict[str, float]:
        return asdict(self)


def optimality(model: PipelineModel, examples: DataFrame, C: float = 1.0) -> Optimality:
    """Gradient and curvature of the loss at a fit, summed over weighted rows in one pass.

    Nine sums reach the driver, whatever the table holds. Rows without inputs are left out, as the
    fit leaves them out.
    """
    scorer = scorer_from(model)
    p = 1 / (1 + F.exp(-scorer.margin()))
    x = [F.lit(1.0), *(F.col(name).cast("double") for name in FEATURES)]
    size = len(x)
    slope = [F.sum(F.col("weight") * (p - F.col("target")) * a) for a in x]
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    curve = [F.sum(F.col("weight") * p * (1 - p) * x[i] * x[j]) for i, j in upper]
    usable = examples.filter(scorer.margin().isNotNull() & ~F.isnan(scorer.margin()))
    n, *sums = usable.agg(F.sum("weight"), *slope, *curve).first()
    weights = np.array([0.0, *scorer.weights])
    gradient = C * np.array(sums[:size]) + weights
    hessian = np.zeros((size, size))
    for (i, j), value in zip(upper, sums[size:], strict=True):
        hessian[i, j] = hessian[j, i] = C * value
    hessian += np.diag([0.0] + [1.0] * (size - 1))
    # In units of each input's own curvature, so that a wide input does not hide a narrow one.
    flat = np.diag(hessian) == 0
    unit = np.where(flat, 1.0, np.sqrt(np.diag(hessian)))
    step = np.linalg.lstsq(hessian / np.outer(unit, unit), gradient / unit, rcond=None)[0] / unit
    # Without curvature (a saturated fit) a gradient that is left has no step to judge it by.
    gap = np.inf if gradient[flat].any() else gradient @ step / (2 * C * n)
    return Optimality(float(np.linalg.norm(gradient) / (C * n)), float(gap), float(np.abs(step).max()))


def fit_logistic(df: DataFrame, C: float = 1.0, max_iter: int = 100, tol: float = 1e-8,
                 loss_gap: float = LOSS_GAP) -> tuple[PipelineModel, Optimality]:
    """L2-regularised logistic regression on a training table, labelled ratings or weighted rows,
    minimising C * sum(loss) + |w|^2 / 2, and the proof that it got there.

    Spark ML divides the loss by the summed weight, hence the regularisation 1 / (C * n).
    The solver starts from fixed values and draws nothing at random, so it has no seed. A fit
    further than `loss_gap` above the minimum, whatever made the solver stop, is an error.
    """
    examples = cut_lineage(examples_of(df))
    seen = examples.agg(
        F.sum("weight").alias("n"), F.countDistinct("target").alias("classes")
    ).first()
    if seen["classes"] != 2:
        raise ValueError(f"training needs both classes, found {seen['classes']}")
    logistic = LogisticRegression(
        featuresCol="features", labelCol="target", weightCol="weight",
        regParam=1.0 / (C * seen["n"]), elasticNetParam=0.0, standardization=False,
        fitIntercept=True, maxIter=max_iter, tol=tol,
    )
    model = Pipeline(stages=[assembler(), logistic]).fit(examples)
    reached = optimality(model, examples, C)
    if not reached.loss_gap <= loss_gap:
        raise NotConverged(f"the fit is {reached.loss_gap:.3g} of mean loss above its minimum, "
                           f"{loss_gap:.3g} allowed: {reached}")
    return model, reached


def train_logistic(df: DataFrame, C: float = 1.0, max_iter: int = 100, tol: float = 1e-8,
                   loss_gap: float = LOSS_GAP) -> PipelineModel:
    """The model of `fit_logistic` alone."""
    return fit_logistic(df, C, max_iter, tol, loss_gap)[0]


def model_params(model: PipelineModel) -> dict[str, str]:
    """The hyperparameters of the fitted classifier by name."""
    return {p.name: str(v) for p, v in model.stages[-1].extractParamMap().items()}

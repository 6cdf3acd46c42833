"""A fitted two-feature logistic model as one Column expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed order of the model inputs.
FEATURES = ("avg_rating", "num_movies")


@dataclass(frozen=True)
class LinearScorer:
    """Class 1 where the margin is positive, which is where the probability passes 1/2.

    The expression stays inside whole-stage code generation, with no vector column.
    """

    intercept: float
    weights: tuple[float, ...]

    def margin(self) -> Column:
        total = F.lit(self.intercept)
        for name, weight in zip(FEATURES, self.weights, strict=True):
            total = total + F.lit(weight) * F.col(name).cast("double")
        return total

    def predict(self) -> Column:
        """0 or 1; null where an input is null or not a number."""
        margin = self.margin()
        unusable = margin.isNull() | F.isnan(margin)
        return F.when(unusable, F.lit(None).cast("int")).when(margin > 0, 1).otherwise(0)


def scorer_from(model: PipelineModel | LinearScorer) -> LinearScorer:
    """The expression form of a fitted pipeline (assembler, logistic regression)."""
    if isinstance(model, LinearScorer):
        return model
    logistic = model.stages[-1]
    if logistic.getThreshold() != 0.5:
        raise ValueError("the margin test stands for a threshold of 0.5 only")
    return LinearScorer(float(logistic.intercept), tuple(float(w) for w in logistic.coefficients))

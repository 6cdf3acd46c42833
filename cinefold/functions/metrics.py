"""Classification metrics from the four confusion counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def accuracy(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    """Null without rows."""
    return _ratio(tp + tn, tp + fp + tn + fn)


def roc_auc(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    """Area under the curve of the 0/1 predictions; null unless both classes occur."""
    return (_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2


def precision(tp: Column, fp: Column) -> Column:
    return F.coalesce(_ratio(tp, tp + fp), F.lit(0.0))


def recall(tp: Column, fn: Column) -> Column:
    return F.coalesce(_ratio(tp, tp + fn), F.lit(0.0))


def f1_score(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(_ratio(tp * 2, tp * 2 + fp + fn), F.lit(0.0))

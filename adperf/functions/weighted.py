"""Weighted error algebra.

Every metric here is a function of sums, so Spark combines it map-side and a
key that holds most of the rows shuffles one partial row per input partition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import ratio


def _terms(actual: str, predicted: str, weight: str, where: Column | None):
    error = F.col(predicted) - F.col(actual)
    usable = error.isNotNull() if where is None else error.isNotNull() & where
    return error, F.when(usable, F.col(weight))


def weighted_rmse(actual: str, predicted: str, weight: str, where: Column | None = None) -> Column:
    """sqrt(sum(w e^2) / sum(w)); NULL over no rows."""
    error, w = _terms(actual, predicted, weight, where)
    return F.sqrt(ratio(F.sum(w * error * error), F.sum(w)))


def weighted_mae(actual: str, predicted: str, weight: str, where: Column | None = None) -> Column:
    """sum(w |e|) / sum(w)."""
    error, w = _terms(actual, predicted, weight, where)
    return ratio(F.sum(w * F.abs(error)), F.sum(w))


def weighted_r2(
    actual: str, predicted: str, weight: str, where: Column | None = None, center: Column | float = 0.0
) -> Column:
    """1 - sum(w e^2) / sum(w (y - mean)^2), both from one pass; 1 or 0 for a constant target.

    The spread is a difference of two sums. With a ``center`` near the mean (see
    ``weighted_mean``) both stay small, so nothing cancels at low rates and large weights.
    """
    error, w = _terms(actual, predicted, weight, where)
    y = F.col(actual) - center
    residual = F.sum(w * error * error)
    spread = F.sum(w * y * y) - ratio(F.sum(w * y) * F.sum(w * y), F.sum(w))
    return F.when(spread > 0, F.lit(1.0) - ratio(residual, spread)).otherwise(
        F.when(residual.isNotNull(), F.when(residual == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    )


def weighted_mean(actual: str, predicted: str, weight: str, where: Column | None = None) -> Column:
    """sum(w y) / sum(w) over the rows that the error metrics use."""
    _, w = _terms(actual, predicted, weight, where)
    return ratio(F.sum(w * F.col(actual)), F.sum(w))


def improvement_pct(before: Column, after: Column, digits: int = 1) -> Column:
    """How many percent ``after`` lies below ``before``."""
    return F.round(100.0 * ratio(before - after, before), digits)

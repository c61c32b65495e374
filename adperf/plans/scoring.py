"""Batch scoring of every segment-day."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from ..functions.weighted import weighted_rmse
from .predictions import prior_as_stale, with_gaps

# Fixed value: predicted rates lie between 0 and this.
MAX_CTR = 0.15


def predict(frame: DataFrame, model: PipelineModel, output: str, upper: float = MAX_CTR) -> DataFrame:
    """Add a model's clamped prediction; the encoder's columns do not stay."""
    kept = frame.columns
    return model.transform(frame).select(*kept, clamp("prediction", 0.0, upper).alias(output))


def _finished(scored: DataFrame, version: str, predicted_at: Column | None) -> DataFrame:
    flags = {name: F.col(name).cast("boolean") for name in ("is_drift_window", "is_drift_segment")}
    stamp = F.current_timestamp() if predicted_at is None else predicted_at
    return with_gaps(scored.withColumns(flags), version).withColumn("predicted_at", stamp)


def score_both(
    frame: DataFrame,
    stale: PipelineModel,
    champion: PipelineModel,
    version: str,
    upper: float = MAX_CTR,
    predicted_at: Column | None = None,
) -> DataFrame:
    """Predictions of two models side by side."""
    scored = predict(frame, stale, "predicted_ctr_stale", upper)
    scored = predict(scored, champion, "predicted_ctr_champion", upper)
    return _finished(scored, version, predicted_at)


def score_against_prior(
    frame: DataFrame,
    champion: PipelineModel,
    prior: DataFrame | None,
    version: str,
    upper: float = MAX_CTR,
    predicted_at: Column | None = None,
) -> DataFrame:
    """Predictions of the new champion, with the previous champion's as the stale ones."""
    scored = predict(frame, champion, "predicted_ctr_champion", upper)
    if prior is None:
        scored = scored.withColumn("predicted_ctr_stale", F.lit(None).cast("double"))
    else:
        scored = prior_as_stale(scored, prior)
    return _finished(scored, version, predicted_at)


def incumbent_rmse(predictions: DataFrame | None) -> float | None:
    """Cohort RMSE of the live champion; None without a table or without cohort rows."""
    if predictions is None:
        return None
    cohort = predictions.where("is_drift_segment AND is_drift_window")
    return cohort.agg(weighted_rmse("actual_ctr", "predicted_ctr_champion", "impressions").alias("rmse")).first()["rmse"]

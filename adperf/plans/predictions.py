"""Predicted against actual click rates per segment-day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp, ratio
from ..operators.lookups import lookup_join
from ..schemas import GRAIN

COLUMNS = [
    *GRAIN, "campaign_name", "objective", "impressions", "spend_usd", "actual_ctr",
    "predicted_ctr_stale", "predicted_ctr_champion", "ctr_gap_stale", "ctr_gap_champion",
    "is_drift_window", "is_drift_segment", "model_version_champion",
]


def with_gaps(scored: DataFrame, version: str) -> DataFrame:
    """Add gaps and the version to rows that carry both predictions, in table order."""
    return scored.withColumns(
        {
            "ctr_gap_stale": F.col("predicted_ctr_stale") - F.col("actual_ctr"),
            "ctr_gap_champion": F.col("predicted_ctr_champion") - F.col("actual_ctr"),
            "model_version_champion": F.lit(str(version)),
        }
    ).select(*COLUMNS)


def campaign_means(rollup: DataFrame) -> DataFrame:
    """Click rate of each campaign before and inside the drift window, in one aggregate.

    Works on either daily rollup; the campaign rollup is the smaller input.
    """

    def ctr(where: Column) -> Column:
        clicks = F.sum(F.when(where, F.col("clicks")))
        return ratio(clicks, F.sum(F.when(where, F.col("impressions"))))

    return rollup.groupBy("campaign_id").agg(
        ctr(~F.col("is_drift_window")).alias("baseline_ctr"),
        ctr(F.col("is_drift_window")).alias("drift_ctr"),
    )


def group_mean_predictions(
    segments: DataFrame, upper: float, version: str = "2", means: DataFrame | None = None
) -> DataFrame:
    """Deterministic predictor: stale is the campaign's pre-drift rate, champion the rate of its regime.

    ``means`` are the campaign rates, best as a stored table.
    """
    means = campaign_means(segments) if means is None else means
    regime_ctr = F.when(F.col("is_drift_window"), F.col("drift_ctr")).otherwise(F.col("baseline_ctr"))
    scored = lookup_join(segments, means, "campaign_id", GRAIN).withColumns(
        {
            "predicted_ctr_stale": clamp("baseline_ctr", 0.0, upper),
            "predicted_ctr_champion": clamp(regime_ctr, 0.0, upper),
        }
    )
    return with_gaps(scored, version)


def prior_as_stale(scored: DataFrame, prior: DataFrame) -> DataFrame:
    """Replace the stale prediction by what the previous champion said about the same segment-day.

    The grain is unique on both sides, so no key is hot. Missing key parts match each other.
    """
    previous = prior.select(
        *[F.col(name).alias(f"__{name}") for name in GRAIN], F.col("predicted_ctr_champion").alias("predicted_ctr_stale")
    )
    same = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"__{name}")) for name in GRAIN])
    return scored.drop("predicted_ctr_stale").join(previous, same, "left").drop(*[f"__{name}" for name in GRAIN])

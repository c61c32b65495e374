"""Silver impressions and the two daily rollups."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio, week_start

SEGMENT_KEYS = [
    "event_date", "channel", "campaign_id", "campaign_name", "device", "country", "visitor_type", "objective",
]
CAMPAIGN_KEYS = ["event_date", "channel", "campaign_id", "campaign_name", "objective"]


def silver_impressions(raw: DataFrame, drift_start: date, drift_campaigns: list[str]) -> DataFrame:
    """Raw impressions with the week, the revenue alias and the two drift flags."""
    return raw.select(
        "impression_id", "event_ts", "event_date",
        week_start("event_date").alias("event_week"),
        "campaign_id", "campaign_name", "channel", "objective",
        "device", "country", "visitor_type", "hour_of_day", "day_of_week",
        "clicked", "converted", "cost_usd", "conversion_value_usd",
        F.col("conversion_value_usd").alias("revenue_usd"),
        (F.col("event_date") >= F.lit(drift_start)).alias("is_drift_window"),
        F.col("campaign_id").isin(drift_campaigns).alias("is_drift_segment"),
    )


def _flags() -> list[Column]:
    return [F.bool_or(name).alias(name) for name in ("is_drift_window", "is_drift_segment")]


def segment_ctr_daily(silver: DataFrame) -> DataFrame:
    """One row per segment and day.

    The week follows from the date, so it is added after the aggregate instead
    of widening the shuffle key.
    """
    daily = silver.groupBy(*SEGMENT_KEYS).agg(
        F.count(F.lit(1)).alias("impressions"),
        F.sum("clicked").alias("clicks"),
        F.sum("converted").alias("conversions"),
        F.sum("cost_usd").alias("spend_usd"),
        F.sum("conversion_value_usd").alias("conversion_value_usd"),
        *_flags(),
    )
    return daily.select(
        "event_date", week_start("event_date").alias("event_week"), *SEGMENT_KEYS[1:],
        "impressions", "clicks", "conversions",
        ratio("clicks", "impressions").alias("actual_ctr"),
        ratio("conversions", "clicks").alias("actual_cvr"),
        "spend_usd", "conversion_value_usd", "is_drift_window", "is_drift_segment",
    )


def _campaign_rollup(df: DataFrame, impressions: Column, clicks: str, conversions: str, spend: str) -> DataFrame:
    daily = df.groupBy(*CAMPAIGN_KEYS).agg(
        impressions.alias("impressions"),
        F.sum(clicks).alias("clicks"),
        F.sum(conversions).alias("conversions"),
        F.sum(spend).alias("spend_usd"),
        F.sum("conversion_value_usd").alias("conversion_value_usd"),
        *_flags(),
    )
    return daily.select(
        "event_date", week_start("event_date").alias("event_week"), *CAMPAIGN_KEYS[1:],
        "impressions", "clicks", "conversions",
        ratio("clicks", "impressions").alias("blended_ctr"),
        "spend_usd", "conversion_value_usd", "is_drift_window", "is_drift_segment",
    )


def campaign_daily(silver: DataFrame) -> DataFrame:
    """One row per campaign and day, straight from the impressions."""
    return _campaign_rollup(silver, F.count(F.lit(1)), "clicked", "converted", "cost_usd")


def campaign_daily_from_segments(segments: DataFrame) -> DataFrame:
    """The same table from the segment-day rollup: all measures are sums, so the fact is not read again."""
    return _campaign_rollup(segments, F.sum("impressions"), "clicks", "conversions", "spend_usd")

"""Monitoring metrics table and the health views over it."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.slices import OVERALL, SLICE, rolled_metrics, rolling_sums, slice_baseline, slice_daily
from ..schemas import DIMENSIONS
from ..sources.day_tables import manifest, read_days, replace_days

#: Day tables of the stored form: sums by day and slice, and the sums of all windows that end on a day.
DAILY, ROLLED = "slice_daily", "slice_rolled"

COLUMNS = [
    "metric_date", "window_days", "dimension_name", "dimension_value", "model_version",
    "actual_ctr", "predicted_ctr", "weighted_rmse", "weighted_mae", "signed_bias",
    "absolute_ctr_gap", "baseline_rmse", "rmse_change_pct", "drift_status",
    "observation_count", "impressions", "computed_at",
]


@dataclass(frozen=True)
class MonitorConfig:
    """What is monitored. The defaults are fixed values."""

    windows_days: list[int] = field(default_factory=lambda: [1, 7, 28])
    dimensions: list[str] = field(default_factory=lambda: list(DIMENSIONS))
    warning_pct: float = 10.0
    critical_pct: float = 20.0


def monitoring_metrics(
    predictions: DataFrame, config: MonitorConfig = MonitorConfig(), computed_at: Column | None = None
) -> DataFrame:
    """Daily and rolling impression-weighted accuracy of every slice.

    One scan, one shuffle for the daily sums and one for the windows.
    """
    daily = slice_daily(predictions, config.dimensions)
    rolled = rolling_sums(daily, config.windows_days)
    metrics = rolled_metrics(rolled, config.warning_pct, config.critical_pct)
    stamp = F.current_timestamp() if computed_at is None else computed_at
    return metrics.withColumn("computed_at", stamp).select(*COLUMNS)


def refresh_windows(
    spark: SparkSession, predictions: DataFrame, root: str, days: list[date], config: MonitorConfig = MonitorConfig()
) -> list[date]:
    """Bring the stored sums up to date after ``days`` came, or came again; returns the days whose windows were rewritten.

    ``predictions`` are those of the given days, others are left out. A day changes
    the windows that end on it or on one of the following days, as far as the longest
    window reaches; only these are rewritten, from the stored sums of the days before.
    """
    reach = max(config.windows_days)
    part = predictions.where(F.col("event_date").isin(days))
    replace_days(slice_daily(part, config.dimensions), f"{root}/{DAILY}", days, "metric_date")
    known = {date.fromisoformat(day) for day in manifest(spark, f"{root}/{DAILY}")["days"]}
    behind = {day + timedelta(k) for day in days for k in range(reach)}
    ends = sorted(behind & (known | set(days)))
    needed = sorted({end - timedelta(k) for end in ends for k in range(reach)} & known)
    rolled = rolling_sums(read_days(spark, f"{root}/{DAILY}", needed), config.windows_days).drop("baseline_rmse")
    replace_days(rolled.where(F.col("metric_date").isin(ends)), f"{root}/{ROLLED}", ends, "metric_date")
    return ends


def stored_metrics(
    spark: SparkSession, root: str, config: MonitorConfig = MonitorConfig(), computed_at: Column | None = None
) -> DataFrame:
    """The table of ``monitoring_metrics`` from the stored sums; the fact is not read.

    The pre-drift error of a slice is a sum over all days, so it is taken when the table
    is read: one row for each slice, from the sums by day.
    """
    baseline = slice_baseline(read_days(spark, f"{root}/{DAILY}"))
    rolled = read_days(spark, f"{root}/{ROLLED}").join(baseline, SLICE, "left")
    metrics = rolled_metrics(rolled, config.warning_pct, config.critical_pct)
    stamp = F.current_timestamp() if computed_at is None else computed_at
    return metrics.withColumn("computed_at", stamp).select(*COLUMNS)


def _is_overall() -> Column:
    return (F.col("dimension_name") == OVERALL[0]) & (F.col("dimension_value") == OVERALL[1])


def health_trend(metrics: DataFrame, window_days: int = 7) -> DataFrame:
    """History of the overall slice, oldest first."""
    return metrics.where(_is_overall() & (F.col("window_days") == window_days)).orderBy("metric_date")


def health_latest_overall(metrics: DataFrame, window_days: int = 7) -> DataFrame:
    """The newest overall row."""
    overall = metrics.where(_is_overall() & (F.col("window_days") == window_days))
    number = F.expr("try_cast(model_version AS BIGINT)")
    return overall.orderBy(F.col("metric_date").desc(), number.desc(), F.col("model_version").desc()).limit(1)


def health_slices_latest(metrics: DataFrame, window_days: int = 7) -> DataFrame:
    """The newest row of every slice of every dimension, without sorting a slice's history."""
    rest = [name for name in metrics.columns if name not in SLICE]
    return (
        metrics.where((F.col("dimension_name") != OVERALL[0]) & (F.col("window_days") == window_days))
        .groupBy(*SLICE)
        .agg(F.max_by(F.struct(*rest), "metric_date").alias("newest"))
        .select(*SLICE, "newest.*")
        .select(*metrics.columns)
    )

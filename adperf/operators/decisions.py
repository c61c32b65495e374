"""Retrain and promotion decisions, as set operations over whole tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_match
from ..sources.tables import literal_rows
from .slices import OVERALL, SLICE

# A trigger concerns a slice, whichever model version was live.
TRIGGER_KEYS = ["dimension_name", "dimension_value"]

# The reasons that the audit log holds.
TOO_LITTLE_HISTORY = "insufficient metric history"
TOO_FEW_IMPRESSIONS = "minimum impression volume not met"
COOLING_DOWN = "retraining cooldown is active"
NOT_PERSISTENT = "critical threshold has not persisted"
RETRAIN = "persistent critical drift exceeded the retraining threshold"
NO_INCUMBENT = "No incumbent prediction metric exists"


@dataclass(frozen=True)
class RetrainPolicy:
    """When to retrain. The defaults are fixed values."""

    consecutive_critical_periods: int = 2
    minimum_impressions: int = 50_000
    retrain_cooldown_days: int = 7
    window_days: int = 7


def as_utc(moment: datetime) -> datetime:
    """Naive times are read as UTC."""
    return moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)


def recent_state(metrics: DataFrame, policy: RetrainPolicy) -> DataFrame:
    """Per slice: the newest row, how many of the newest N rows exist, and whether all are critical."""
    newest_first = Window.partitionBy(*SLICE).orderBy(F.col("metric_date").desc())
    recent = (
        metrics.where(F.col("window_days") == policy.window_days)
        .withColumn("age", F.row_number().over(newest_first))
        .where(F.col("age") <= policy.consecutive_critical_periods)
    )
    newest = F.struct("metric_date", "weighted_rmse", "baseline_rmse", "rmse_change_pct", "impressions")
    return (
        recent.groupBy(*SLICE)
        .agg(
            F.count(F.lit(1)).alias("periods"),
            F.bool_and(F.coalesce(F.col("drift_status") == "critical", F.lit(False))).alias("all_critical"),
            F.min_by(newest, "age").alias("newest"),
        )
        .select(*SLICE, "periods", "all_critical", "newest.*")
    )


def last_triggers(log: DataFrame) -> DataFrame:
    """When each slice last asked for a retrain."""
    return log.where("should_retrain").groupBy(*TRIGGER_KEYS).agg(F.max("evaluated_at").alias("last_trigger"))


def overall_slice(spark: SparkSession) -> DataFrame:
    """The overall slice as a one-row table."""
    return literal_rows(spark, [OVERALL], "dimension_name string, dimension_value string")


def retrain_decisions(
    metrics: DataFrame,
    policy: RetrainPolicy,
    now: datetime,
    log: DataFrame | None = None,
    slices: DataFrame | None = None,
) -> DataFrame:
    """One decision per slice and model version, with the reason.

    ``slices`` names the slices that must get a decision even without any
    metrics; by default every slice in ``metrics`` gets one.
    """
    state = recent_state(metrics, policy)
    if slices is not None:
        state = slices.join(state, TRIGGER_KEYS, "left")
    if log is not None:
        state = state.join(last_triggers(log), TRIGGER_KEYS, "left")
    else:
        state = state.withColumn("last_trigger", F.lit(None).cast("timestamp"))
    now = as_utc(now)
    cooldown_from = now - timedelta(days=policy.retrain_cooldown_days)
    impressions = F.coalesce(F.col("impressions"), F.lit(0).cast("bigint"))
    reason = first_match(
        [
            (
                F.coalesce(F.col("periods"), F.lit(0)) < policy.consecutive_critical_periods,
                F.lit(TOO_LITTLE_HISTORY),
            ),
            (impressions < policy.minimum_impressions, F.lit(TOO_FEW_IMPRESSIONS)),
            (F.col("last_trigger") > F.lit(cooldown_from), F.lit(COOLING_DOWN)),
            (~F.col("all_critical"), F.lit(NOT_PERSISTENT)),
        ],
        RETRAIN,
    )
    return state.select(
        F.col("metric_date").cast("string").alias("metric_date"),
        "weighted_rmse", "baseline_rmse", "rmse_change_pct",
        impressions.alias("impressions"),
        (reason == RETRAIN).alias("should_retrain"),
        reason.alias("reason"),
        F.lit(now).cast("timestamp").alias("evaluated_at"),
        *SLICE,
    )


def decision_history(log: DataFrame) -> DataFrame:
    """The audit log, newest evaluation first."""
    return log.orderBy(F.col("evaluated_at").desc(), *SLICE)


def promotion_gate(candidates: DataFrame, min_improvement_pct: float) -> DataFrame:
    """Decide on (candidate_rmse, incumbent_rmse) rows; other columns are kept."""
    allowed = F.col("incumbent_rmse") * (1.0 - min_improvement_pct / 100.0)
    met = F.col("candidate_rmse") <= allowed
    promoted = F.col("incumbent_rmse").isNull() | F.coalesce(met, F.lit(False))
    reason = first_match(
        [
            (F.col("incumbent_rmse").isNull(), F.lit(NO_INCUMBENT)),
            (met, F.format_string("Candidate RMSE %.5f met threshold %.5f", F.col("candidate_rmse"), allowed)),
        ],
        None,
    )
    exceeded = F.format_string("Candidate RMSE %.5f exceeded threshold %.5f", F.col("candidate_rmse"), allowed)
    return candidates.withColumns({"promoted": promoted, "reason": F.coalesce(reason, exceeded)})

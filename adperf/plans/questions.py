"""Business questions over the daily rollups and the predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio, week_start
from ..functions.weighted import improvement_pct, weighted_mae, weighted_r2, weighted_rmse
from ..operators.lookups import lookup_join
from ..schemas import GRAIN, SEGMENT

# The channels whose share the mix shift is read from.
SHIFTED_CHANNELS = ["Social", "Display"]

IN_WINDOW = "is_drift_window"


def _cohort() -> Column:
    return F.col("is_drift_segment") & F.col(IN_WINDOW)


def _sum_if(where: Column, value: str) -> Column:
    return F.sum(F.when(where, F.col(value)))


def biggest_gap_by_channel(predictions: DataFrame) -> DataFrame:
    """Average stale gap and click rate per channel in the drift window."""
    return (
        predictions.where(IN_WINDOW)
        .groupBy("channel")
        .agg(
            F.round(F.avg("ctr_gap_stale"), 4).alias("avg_stale_gap"),
            F.round(F.avg("actual_ctr"), 4).alias("avg_actual_ctr"),
        )
        .orderBy(F.col("avg_stale_gap").desc(), "channel")
    )


def champion_vs_stale_gap(predictions: DataFrame) -> DataFrame:
    """Average size of both models' gaps per channel in the drift window."""
    return (
        predictions.where(IN_WINDOW)
        .groupBy("channel")
        .agg(
            F.round(F.avg(F.abs("ctr_gap_stale")), 4).alias("avg_abs_stale_gap"),
            F.round(F.avg(F.abs("ctr_gap_champion")), 4).alias("avg_abs_champion_gap"),
        )
        .orderBy(F.col("avg_abs_stale_gap").desc(), "channel")
    )


def accuracy_lift_by_channel(predictions: DataFrame) -> DataFrame:
    """How much smaller the champion's average gap is, per channel in the drift window."""
    lift = F.avg(F.abs("ctr_gap_stale")) - F.avg(F.abs("ctr_gap_champion"))
    return predictions.where(IN_WINDOW).groupBy("channel").agg(lift.alias("accuracy_lift"))


def champion_tracking(predictions: DataFrame) -> DataFrame:
    """Average gaps of both models inside and outside the drifted cohort."""
    return predictions.groupBy(_cohort().alias("in_cohort")).agg(
        F.avg("ctr_gap_stale").alias("avg_stale_gap"),
        F.avg("ctr_gap_champion").alias("avg_champion_gap"),
        F.count(F.lit(1)).alias("segment_days"),
    )


def impression_mix_weekly(campaigns: DataFrame) -> DataFrame:
    """Impressions per week and channel."""
    return (
        campaigns.groupBy("event_week", "channel")
        .agg(F.sum("impressions").alias("impressions"))
        .orderBy("event_week", "channel")
    )


def impression_share_weekly(campaigns: DataFrame) -> DataFrame:
    """Each channel's share of the week's impressions, and its click rate."""
    weekly = campaigns.groupBy("event_week", "channel").agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks")
    )
    week_total = F.sum("impressions").over(Window.partitionBy("event_week"))
    return weekly.select(
        "event_week", "channel", "impressions",
        ratio("impressions", week_total).alias("impression_share"),
        ratio("clicks", "impressions").alias("ctr"),
    )


def weekly_ctr(segments: DataFrame, channels: list[str] = SHIFTED_CHANNELS) -> DataFrame:
    """Weekly click rate of the given channels."""
    return (
        segments.where(F.col("channel").isin(channels))
        .groupBy("event_week", "channel")
        .agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))
        .select("event_week", "channel", "impressions", ratio("clicks", "impressions").alias("actual_ctr"))
        .orderBy("event_week", "channel")
    )


def wasted_spend_rows(predictions: DataFrame, means: DataFrame) -> DataFrame:
    """Cohort rows with the part of their spend that bought clicks at the pre-drift rate."""
    shortfall = F.lit(1.0) - ratio("actual_ctr", "baseline_ctr")
    baselines = means.select("campaign_id", "baseline_ctr")
    cohort = lookup_join(predictions.where(_cohort()), baselines, "campaign_id", GRAIN)
    return cohort.withColumn("wasted_spend_usd", F.col("spend_usd") * F.greatest(F.lit(0.0), shortfall))


def wasted_spend_total(predictions: DataFrame, means: DataFrame) -> DataFrame:
    """Total wasted spend, in whole units."""
    return wasted_spend_rows(predictions, means).agg(
        F.round(F.sum("wasted_spend_usd"), 0).alias("wasted_spend_usd")
    )


def wasted_spend_by_channel(predictions: DataFrame, means: DataFrame) -> DataFrame:
    """Wasted spend per channel."""
    return (
        wasted_spend_rows(predictions, means)
        .groupBy("channel")
        .agg(F.sum("wasted_spend_usd").alias("wasted_spend_usd"))
    )


def kpi_row(campaigns: DataFrame, predictions: DataFrame, means: DataFrame) -> DataFrame:
    """One row: impressions, blended rates and wasted spend.

    Both inputs are reduced to partial rows and summed in one last aggregate,
    instead of joining two one-row results.
    """
    nothing = F.lit(0).cast("bigint")
    volume = campaigns.groupBy("channel").agg(
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
        F.sum("conversions").alias("conversions"),
    ).withColumn("wasted_spend_usd", F.lit(None).cast("double"))
    waste = wasted_spend_by_channel(predictions, means).withColumns(
        {"impressions": nothing, "clicks": nothing, "conversions": nothing}
    )
    return volume.unionByName(waste).agg(
        F.sum("impressions").alias("impressions"),
        ratio(F.sum("clicks"), F.sum("impressions")).alias("blended_ctr"),
        ratio(F.sum("conversions"), F.sum("clicks")).alias("blended_cvr"),
        F.sum("wasted_spend_usd").alias("wasted_spend_usd"),
    )


def predicted_vs_actual_weekly(predictions: DataFrame) -> DataFrame:
    """Weekly averages of the actual rate and both predictions."""
    return (
        predictions.groupBy(week_start("event_date").alias("event_week"))
        .agg(*[F.avg(name).alias(f"avg_{name}") for name in (
            "actual_ctr", "predicted_ctr_stale", "predicted_ctr_champion")])
        .orderBy("event_week")
    )


def ctr_by_channel_before_after(campaigns: DataFrame) -> DataFrame:
    """Click rate per channel before and inside the drift window."""
    after = F.col(IN_WINDOW)
    return campaigns.groupBy("channel").agg(
        ratio(_sum_if(~after, "clicks"), _sum_if(~after, "impressions")).alias("ctr_before"),
        ratio(_sum_if(after, "clicks"), _sum_if(after, "impressions")).alias("ctr_after"),
    )


def worst_segments(predictions: DataFrame, means: DataFrame) -> DataFrame:
    """Every segment of the drift window, those that the stale model over-predicts most first."""
    keys = ["channel", "campaign_id", "campaign_name", "device", "country"]
    waste = F.when(
        F.col("is_drift_segment"),
        F.col("spend_usd")
        * F.greatest(F.lit(0.0), F.lit(1.0) - ratio("actual_ctr", "baseline_ctr")),
    )
    rates = ["actual_ctr", "predicted_ctr_stale", "predicted_ctr_champion", "ctr_gap_stale"]
    baselines = means.select("campaign_id", "baseline_ctr")
    return (
        lookup_join(predictions.where(IN_WINDOW), baselines, "campaign_id", GRAIN)
        .withColumn("wasted", waste)
        .groupBy(*keys)
        .agg(
            *[ratio(F.sum(F.col(name) * F.col("impressions")), F.sum("impressions")).alias(name) for name in rates],
            F.coalesce(F.sum("wasted"), F.lit(0.0)).alias("wasted_spend_usd"),
        )
        .orderBy(F.round("ctr_gap_stale", 6).desc(), *keys)
    )


def segment_gaps(predictions: DataFrame, means: DataFrame) -> DataFrame:
    """Every segment of the drift window: rates and gaps of both models, spend and wasted spend."""
    shortfall = F.greatest(F.lit(0.0), F.lit(1.0) - ratio("actual_ctr", "baseline_ctr"))
    wasted = F.when(F.col("is_drift_segment"), F.col("spend_usd") * shortfall)
    rates = ["actual_ctr", "predicted_ctr_stale", "predicted_ctr_champion", "ctr_gap_stale", "ctr_gap_champion"]
    baselines = means.select("campaign_id", "baseline_ctr")
    return (
        lookup_join(predictions.where(IN_WINDOW), baselines, "campaign_id", GRAIN)
        .withColumn("wasted", wasted)
        .groupBy(*SEGMENT, "is_drift_segment")
        .agg(
            F.sum("impressions").alias("impressions"),
            *[ratio(F.sum(F.col(name) * F.col("impressions")), F.sum("impressions")).alias(name) for name in rates],
            F.sum("spend_usd").alias("spend_usd"),
            F.coalesce(F.sum("wasted"), F.lit(0.0)).alias("wasted_spend_usd"),
        )
    )


def cohort_ctr(segments: DataFrame) -> DataFrame:
    """Click rate of the drifted campaigns before and inside the drift window, in one pass."""
    member, after = F.col("is_drift_segment"), F.col(IN_WINDOW)
    return segments.agg(
        ratio(_sum_if(member & ~after, "clicks"), _sum_if(member & ~after, "impressions")).alias("predrift_ctr"),
        ratio(_sum_if(member & after, "clicks"), _sum_if(member & after, "impressions")).alias("drift_ctr"),
    )


def mix_share_by_regime(campaigns: DataFrame, channels: list[str] = SHIFTED_CHANNELS) -> DataFrame:
    """Share of the given channels in all impressions, per regime."""
    inside = F.when(F.col("channel").isin(channels), F.col("impressions")).otherwise(F.lit(0))
    return campaigns.groupBy(IN_WINDOW).agg(
        ratio(F.sum(inside), F.sum("impressions")).alias("shifted_channel_share")
    )


def segment_count(segments: DataFrame) -> DataFrame:
    """How many distinct segments exist; a NULL part counts as a value."""
    return segments.select(*SEGMENT).distinct().agg(F.count(F.lit(1)).alias("segments"))


def model_metrics(predictions: DataFrame) -> DataFrame:
    """Weighted errors of both models, over everything and over the drifted cohort, in one pass."""

    def of(model: str, where: Column | None = None) -> tuple[str, str, str, Column | None]:
        return "actual_ctr", f"predicted_ctr_{model}", "impressions", where

    stale, champion = (weighted_rmse(*of(m, _cohort())) for m in ("stale", "champion"))
    columns = [
        metric(*of(model)).alias(f"{name}_{model}")
        for model in ("stale", "champion")
        for name, metric in (("rmse", weighted_rmse), ("mae", weighted_mae), ("r2", weighted_r2))
    ]
    return predictions.agg(
        *columns,
        stale.alias("rmse_misbid_cohort_stale"),
        champion.alias("rmse_misbid_cohort_champion"),
        improvement_pct(stale, champion).alias("rmse_improvement_pct"),
    )



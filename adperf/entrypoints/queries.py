"""The named queries over the given tables.

Doubles are rounded at this edge only, so that sums taken in another order
compare equal; the library functions do not round unless the report asks for it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from ..functions.weighted import weighted_rmse
from ..operators import bands, decisions, filters, layers, lookups, slices
from ..plans import (
    features, lifecycle, monitoring, predictions, quality, questions, registry, scoring, training,
)
from ..schemas import GRAIN
from ..session import checkpoint_dir, materialize, split_hot_keys
from ..sources import events, order_lines
from ..sources.day_tables import read_days
from ..sources.tables import append_table, comment_columns, create_database, overwrite_table, replace_table

Query = Callable[[SparkSession, str], DataFrame]

# Predictions may reach any rate, as click rates of the given events are higher than those of real ads.
UPPER = 1.0
# Bounds of the checks. They are not fitted to the tables, so some of the checks fail there.
ROW_TARGET = (9_000, 11_000)
WASTE_BAND = (1_000.0, 5_000.0)
DAYS = (date(2024, 1, 1), date(2024, 1, 31))
POLICY = decisions.RetrainPolicy(minimum_impressions=500)
EVALUATIONS = [
    datetime(2024, 1, 22, 7, tzinfo=timezone.utc),
    datetime(2024, 1, 25, 7, tzinfo=timezone.utc),
    datetime(2024, 1, 29, 7, tzinfo=timezone.utc),
    datetime(2024, 2, 1, 7, tzinfo=timezone.utc),
]
MODEL = "ctr_regressor"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, without negative zeros."""
    return df.select(
        *[
            scalars.rounded(field.name, digits).alias(field.name)
            if isinstance(field.dataType, T.DoubleType)
            else F.col(f"`{field.name}`")
            for field in df.schema.fields
        ]
    )


# ---- inputs -------------------------------------------------------------


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.impressions(spark, sf_dir, click_loss=events.CLICK_LOSS)


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.silver_impressions(_raw(spark, sf_dir), events.DRIFT_START, events.DRIFT_CAMPAIGNS)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.segment_ctr_daily(_silver(spark, sf_dir))


def _campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.campaign_daily(_silver(spark, sf_dir))


def _stored_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment-days as a written table, for queries that read them more than once."""
    return materialize(_segments(spark, sf_dir))


def _stored_means(segments: DataFrame) -> DataFrame:
    """The campaign rates as a written table, which can be counted before the segment-days are joined."""
    return materialize(predictions.campaign_means(segments))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions_and_means(spark, sf_dir)[0]


def _predictions_and_means(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    segments = _stored_segments(spark, sf_dir)
    means = _stored_means(segments)
    return predictions.group_mean_predictions(segments, UPPER, means=means), means


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.monitoring_metrics(_predictions(spark, sf_dir)).drop("computed_at")


def _incumbent_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the stale model while it is still the live one."""
    live = _predictions(spark, sf_dir).withColumns(
        {"predicted_ctr_champion": F.col("predicted_ctr_stale"), "model_version_champion": F.lit("1")}
    )
    return materialize(monitoring.monitoring_metrics(live).drop("computed_at"))


def _decisions(metrics: DataFrame, evaluations: list[datetime]) -> list[DataFrame]:
    """The decisions of several evaluations, each seeing the days before it and the log so far."""
    decided: list[DataFrame] = []
    for now in evaluations:
        known = metrics.where(F.col("metric_date") < F.lit(now.date()))
        log = reduce(DataFrame.unionByName, decided) if decided else None
        decision = decisions.retrain_decisions(known, POLICY, now, log)
        decided.append(decision if now == evaluations[-1] else materialize(decision))
    return decided


def _naive(df: DataFrame) -> DataFrame:
    """Instants as UTC wall-clock times."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("evaluated_at").cast("timestamp_ntz"))
    return df.withColumn("evaluated_at", utc)


# ---- adapter and layers -------------------------------------------------


def impressions(spark, sf_dir):
    return rounded(_raw(spark, sf_dir))


def raw_campaigns(spark, sf_dir):
    return rounded(events.campaigns(_raw(spark, sf_dir)))


def silver_impressions(spark, sf_dir):
    return rounded(_silver(spark, sf_dir))


def segment_ctr_daily(spark, sf_dir):
    return rounded(_segments(spark, sf_dir))


def campaign_daily(spark, sf_dir):
    return rounded(_campaigns(spark, sf_dir))


def campaign_daily_from_segments(spark, sf_dir):
    return rounded(layers.campaign_daily_from_segments(_segments(spark, sf_dir)))


def order_line_segment_daily(spark, sf_dir):
    split_hot_keys(spark)
    silver = layers.silver_impressions(
        order_lines.impressions(spark, sf_dir), order_lines.DRIFT_START, order_lines.DRIFT_BRANDS
    )
    return rounded(layers.segment_ctr_daily(silver))


# ---- lookups ------------------------------------------------------------


def band_lookup(spark, sf_dir):
    return events.join_visitor_bands(events.keyed_events(spark, sf_dir)).select(
        "event_id", "device", "country", "visitor_type"
    )


def _customer_weights(spark, sf_dir) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return (
        spark.read.parquet(f"{sf_dir}/orders.parquet")
        .groupBy("o_custkey")
        .agg(F.sum(cents).alias("cents"))
        .where(F.col("cents") > 0)
    )


def cumulative_bands(spark, sf_dir):
    return rounded(bands.cumulative_bands(_customer_weights(spark, sf_dir), "o_custkey", "cents"), 9)


def weighted_pick(spark, sf_dir):
    table = bands.cumulative_bands(_customer_weights(spark, sf_dir), "o_custkey", "cents")
    points = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", ((F.col("event_id") * 7919 % 1_000_003) / 1_000_003.0).alias("point")
    )
    return bands.disjoint_band_join(points, table, "point").select("event_id", "o_custkey")


def regime_lookup(spark, sf_dir):
    """Pick a channel by bands that differ before and inside the drift window."""
    weights = _campaigns(spark, sf_dir).groupBy("is_drift_window", "channel").agg(
        F.sum("impressions").alias("impressions")
    )
    table = bands.cumulative_bands(weights, "channel", "impressions", by=["is_drift_window"])
    points = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        (F.to_date("ts") >= F.lit(events.DRIFT_START)).alias("is_drift_window"),
        ((F.col("event_id") * 7919 % 1_000_003) / 1_000_003.0).alias("point"),
    )
    picked = bands.band_join(points, table, "point", on=["is_drift_window"])
    return picked.select("event_id", "is_drift_window", F.col("channel").alias("picked_channel"))


def filtered_slice(spark, sf_dir):
    """A report over some days; the days are also a filter on the scan."""
    first, last = date(2024, 1, 10), date(2024, 1, 25)
    raw = events.impressions(spark, sf_dir, first, last, events.CLICK_LOSS)
    silver = layers.silver_impressions(raw, events.DRIFT_START, events.DRIFT_CAMPAIGNS)
    kept = filters.filtered_slice(
        layers.segment_ctr_daily(silver),
        date_from=first,
        date_to=last,
        channels=["Search", "Social"],
        countries=["US", "GB", "DE"],
    )
    return rounded(kept.groupBy("channel", "country").agg(
        F.sum("impressions").alias("impressions"), F.sum("spend_usd").alias("spend_usd")
    ))


# ---- questions ----------------------------------------------------------


def _on_predictions(question) -> Query:
    return lambda spark, sf_dir: rounded(question(_predictions(spark, sf_dir)))


def _on_campaigns(question) -> Query:
    return lambda spark, sf_dir: rounded(question(_campaigns(spark, sf_dir)))


def _on_segments(question) -> Query:
    return lambda spark, sf_dir: rounded(question(_segments(spark, sf_dir)))


def _on_waste(question) -> Query:
    return lambda spark, sf_dir: rounded(question(*_predictions_and_means(spark, sf_dir)))


def kpi_row(spark, sf_dir):
    segments = _stored_segments(spark, sf_dir)
    means = _stored_means(segments)
    predicted = predictions.group_mean_predictions(segments, UPPER, means=means)
    return rounded(questions.kpi_row(layers.campaign_daily_from_segments(segments), predicted, means))


# ---- model metrics and features -----------------------------------------


def prior_as_stale(spark, sf_dir):
    """The campaign means of the whole period score against the champion of before."""
    segments = _stored_segments(spark, sf_dir)
    live = predictions.group_mean_predictions(segments, UPPER, means=_stored_means(segments))
    prior = live.where(F.col("event_date") < F.lit(date(2024, 1, 28)))
    overall = materialize(segments.groupBy("campaign_id").agg(
        scalars.ratio(F.sum("clicks"), F.sum("impressions")).alias("predicted_ctr_champion")
    ))
    scored = lookups.lookup_join(segments, overall, "campaign_id", GRAIN)
    return rounded(predictions.with_gaps(predictions.prior_as_stale(scored, prior), "3"))


def feature_frame(spark, sf_dir):
    return rounded(features.feature_frame(_segments(spark, sf_dir)))


def one_hot_wide(spark, sf_dir):
    frame = features.feature_frame(_stored_segments(spark, sf_dir))
    return features.one_hot_wide(frame, features.fit_encoder(frame, features.FEATURE_SETS["fs_a_core"]))


def level_ids(spark, sf_dir):
    """The levels of the encoded columns by number, with the rows of each."""
    frame = features.feature_frame(_segments(spark, sf_dir))
    names = features.CATEGORICALS
    rows = frame.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("level")) for c in names])).alias("pair")
    ).select("pair.*").groupBy("name", "level").count()
    return features.level_dictionary(frame, names).join(rows, ["name", "level"]).withColumnRenamed("count", "rows")


def training_weights(spark, sf_dir):
    return _segments(spark, sf_dir).select(*GRAIN, "impressions", features.training_weight().alias("train_weight"))


def hash_split(spark, sf_dir):
    frame = features.feature_frame(_segments(spark, sf_dir))
    return features.with_split(frame).select(*GRAIN, features.split_bucket().alias("bucket"), "is_validation")


# ---- monitoring and decisions -------------------------------------------


def _daily(spark, sf_dir):
    return slices.slice_daily(_predictions(spark, sf_dir), monitoring.MonitorConfig().dimensions)


def slice_daily(spark, sf_dir):
    return rounded(_daily(spark, sf_dir), 8)


def slice_baseline(spark, sf_dir):
    return rounded(slices.slice_baseline(_daily(spark, sf_dir)))


def _on_metrics(view) -> Query:
    return lambda spark, sf_dir: rounded(view(_metrics(spark, sf_dir)))


def monitoring_metrics(spark, sf_dir):
    return rounded(_metrics(spark, sf_dir))


def retrain_decision(spark, sf_dir):
    """The third evaluation, for every slice."""
    return rounded(_naive(_decisions(_incumbent_metrics(spark, sf_dir), EVALUATIONS[:3])[-1]))


def decision_history(spark, sf_dir):
    log = reduce(DataFrame.unionByName, _decisions(_incumbent_metrics(spark, sf_dir), EVALUATIONS))
    return rounded(_naive(decisions.decision_history(log)))


def promotion_gate(spark, sf_dir):
    """Gate per campaign: the champion's drift-window error against the stale model's on the cohort."""
    after = F.col("is_drift_window")
    candidates = _predictions(spark, sf_dir).groupBy("campaign_id").agg(
        weighted_rmse("actual_ctr", "predicted_ctr_champion", "impressions", after).alias("candidate_rmse"),
        weighted_rmse(
            "actual_ctr", "predicted_ctr_stale", "impressions", after & F.col("is_drift_segment")
        ).alias("incumbent_rmse"),
    )
    return rounded(decisions.promotion_gate(candidates, 5.0))


# ---- quality ------------------------------------------------------------


def dq_rows(spark, sf_dir):
    keys = ["impression_id", *GRAIN]
    return rounded(quality.fact_checks(_silver(spark, sf_dir), keys, *ROW_TARGET, scoring.MAX_CTR))


def dq_mix_and_waste(spark, sf_dir):
    segments = _stored_segments(spark, sf_dir)
    means = _stored_means(segments)
    predicted = predictions.group_mean_predictions(segments, UPPER, means=means)
    mix = quality.mix_shift(layers.campaign_daily_from_segments(segments))
    return rounded(mix.unionByName(quality.waste_in_band(predicted, means, *WASTE_BAND)))


def dq_segments(spark, sf_dir):
    counted = questions.segment_count(_segments(spark, sf_dir))
    return rounded(quality.segment_count_check(counted, 1, 12 * 3 * 6 * 2))


def dq_days_present(spark, sf_dir):
    return quality.days_present(_segments(spark, sf_dir), *DAYS)


def dq_countries(spark, sf_dir):
    countries = [name for name, _, _ in events.COUNTRY_BANDS]
    return quality.values_present(_silver(spark, sf_dir), "country", countries)


def dq_gap(spark, sf_dir):
    return rounded(quality.gap_checks(_predictions(spark, sf_dir), 0.01))


def dq_metric_coverage(spark, sf_dir):
    return quality.metric_coverage(_metrics(spark, sf_dir))


def hot_key_join(spark, sf_dir):
    """Every impression with the totals of its campaign, joined as if the totals were a large table."""
    raw = materialize(_raw(spark, sf_dir))
    totals = materialize(
        raw.groupBy("campaign_id").agg(F.max("campaign_name").alias("name"), F.count(F.lit(1)).alias("total"))
    )
    joined = lookups.lookup_join(raw, totals, "campaign_id", ["impression_id"], small_rows=0)
    return joined.groupBy("event_date", "campaign_id").agg(
        F.count(F.lit(1)).alias("impressions"), F.sum("total").alias("totals"), F.max("name").alias("name")
    )


# ---- writers --------------------------------------------------------------

LATE_DAY = date(2024, 1, 15)


def _table_days(df: DataFrame) -> list[date]:
    """The days of a table, one row each."""
    return [row[0] for row in df.select("event_date").distinct().orderBy("event_date").collect()]


def refresh_by_day(spark, sf_dir):
    """The rollup after all days were written and one of them came again without its tablets."""
    raw = materialize(_raw(spark, sf_dir))
    root = f"{checkpoint_dir(spark)}/days_{uuid.uuid4().hex}"
    drift = (events.DRIFT_START, events.DRIFT_CAMPAIGNS)
    lifecycle.refresh_days(spark, raw, root, _table_days(raw), *drift)
    lifecycle.refresh_days(spark, raw.where(F.col("device") != "Tablet"), root, [LATE_DAY], *drift)
    return rounded(read_days(spark, f"{root}/{lifecycle.SEGMENTS}"))


def refresh_by_day_campaigns(spark, sf_dir):
    """The campaign rollup after one day was taken away and another came again."""
    raw = materialize(_raw(spark, sf_dir))
    root = f"{checkpoint_dir(spark)}/days_{uuid.uuid4().hex}"
    drift = (events.DRIFT_START, events.DRIFT_CAMPAIGNS)
    lifecycle.refresh_days(spark, raw, root, _table_days(raw), *drift)
    lifecycle.refresh_days(spark, raw.where("false"), root, [LATE_DAY], *drift)
    return rounded(read_days(spark, f"{root}/{lifecycle.CAMPAIGNS}"))


def monitoring_incremental(spark, sf_dir):
    """The metrics from stored sums, where the last day came after the others and one day came late."""
    predicted = materialize(_predictions(spark, sf_dir))
    root = f"{checkpoint_dir(spark)}/windows_{uuid.uuid4().hex}"
    *days, last = _table_days(predicted)
    early = [day for day in days if day != LATE_DAY]
    for some in (early, [last], [LATE_DAY]):
        monitoring.refresh_windows(spark, predicted, root, some)
    return rounded(monitoring.stored_metrics(spark, root).drop("computed_at"))


def written_tables(spark, sf_dir):
    """A table that was overwritten, appended to with a new column, and replaced from itself."""
    database, _ = _fresh_database(spark)
    name = f"{database}.by_channel"
    by_channel = _campaigns(spark, sf_dir).groupBy("channel").agg(F.sum("impressions").alias("impressions"))
    overwrite_table(by_channel.withColumn("old", F.lit(1)), name, "to be overwritten")
    rows = overwrite_table(by_channel, name, "impressions by channel")
    rows += append_table(by_channel.select(F.lower("channel").alias("channel"), F.lit("copy").alias("origin")), name)
    comment_columns(spark, name, {"channel": "where the advert was shown"})
    shown = f"{database}.shown"
    replace_table(spark.table(name).withColumn("rows_written", F.lit(rows)), shown)
    replace_table(spark.table(shown).withColumn("doubled", 2 * F.col("impressions")), shown, "second version")
    result = materialize(spark.table(shown))
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return result


def decision_log(spark, sf_dir):
    """The audit log after four runs of the monitor, the last instant twice."""
    database, _ = _fresh_database(spark)
    replace_table(_predictions(spark, sf_dir), f"{database}.{lifecycle.PREDICTIONS}")
    for now in [*EVALUATIONS, EVALUATIONS[-1]]:
        lifecycle.run_monitor(spark, database, now, policy=POLICY)
    log = spark.table(f"{database}.{lifecycle.DECISIONS}")
    result = materialize(_naive(log).groupBy("evaluated_at").agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if(F.length("reason") > 0).alias("with_reason")
    ))
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return result


# ---- trained models (rows only) -----------------------------------------


def _both_models(spark, sf_dir) -> tuple[DataFrame, training.Trained, training.Trained, list[dict]]:
    """The feature frame, the pre-drift model, and the champion of the whole search with its runs."""
    frame = materialize(features.feature_frame(_segments(spark, sf_dir)))
    stale = training.train_stale(frame)
    champion, runs = training.train_champion(frame)
    return frame, stale, champion, runs


def gbt_scored(spark, sf_dir):
    frame, stale, champion, _ = _both_models(spark, sf_dir)
    return scoring.score_both(frame, stale.pipeline, champion.pipeline, "2")


def hpo_leaderboard(spark, sf_dir):
    ready = training.prepared(features.feature_frame(_segments(spark, sf_dir)))
    return training.leaderboard(training.run_table(spark, training.search(ready, training.TrainingConfig())))


def feature_importance(spark, sf_dir):
    champion, _ = training.train_champion(features.feature_frame(_segments(spark, sf_dir)))
    return training.top_features(training.feature_importance(spark, champion))


def model_facts(spark, sf_dir):
    """What can be said of trained models without knowing their trees, from one whole training."""
    frame, stale, champion, runs = _both_models(spark, sf_dir)
    scored = materialize(scoring.score_both(frame, stale.pipeline, champion.pipeline, "2"))
    log = training.run_table(spark, runs)
    importance = training.feature_importance(spark, champion)
    return training.facts(training.prepared(frame), scored, log, importance, scoring.MAX_CTR)


def _fresh_database(spark) -> tuple[str, str]:
    """A new database in the shared checkpoint folder, and a folder for model files beside it."""
    name = f"adperf_{uuid.uuid4().hex[:12]}"
    root = f"{checkpoint_dir(spark)}/{name}"
    create_database(spark, name, root)
    return name, f"{root}_models"


def _trained_database(spark, sf_dir) -> tuple[str, DataFrame]:
    """Run all three jobs once over the events, in a database of its own."""
    database, artifacts = _fresh_database(spark)
    lifecycle.refresh_tables(
        spark, _raw(spark, sf_dir), database, events.DRIFT_START, events.DRIFT_CAMPAIGNS
    )
    lifecycle.train_initial(spark, database, MODEL, artifacts, EVALUATIONS[0])
    for now in EVALUATIONS[1:3]:
        lifecycle.run_monitor(spark, database, now, policy=POLICY)
    return database, lifecycle.retrain(spark, database, MODEL, artifacts, EVALUATIONS[3])


def retrain_summary(spark, sf_dir):
    database, summary = _trained_database(spark, sf_dir)
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return summary


def dq_registry(spark, sf_dir):
    database, _ = _trained_database(spark, sf_dir)
    aliases = registry.current_aliases(spark.table(f"{database}.model_aliases"))
    checks = (
        quality.versions_check(spark.table(f"{database}.model_versions"), aliases).drop("model_name")
        .unionByName(quality.trial_count_check(spark.table(f"{database}.{lifecycle.RUNS}"), 3, 4))
        .unionByName(quality.decisions_recorded_check(spark.table(f"{database}.{lifecycle.DECISIONS}"), 2))
    )
    checks = materialize(checks)
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return checks


def queries() -> dict[str, Query]:
    """All named queries."""
    return {
        "impressions": impressions,
        "raw_campaigns": raw_campaigns,
        "silver_impressions": silver_impressions,
        "segment_ctr_daily": segment_ctr_daily,
        "campaign_daily": campaign_daily,
        "campaign_daily_from_segments": campaign_daily_from_segments,
        "order_line_segment_daily": order_line_segment_daily,
        "band_lookup": band_lookup,
        "cumulative_bands": cumulative_bands,
        "weighted_pick": weighted_pick,
        "regime_lookup": regime_lookup,
        "filtered_slice": filtered_slice,
        "biggest_gap_by_channel": _on_predictions(questions.biggest_gap_by_channel),
        "impression_mix_weekly": _on_campaigns(questions.impression_mix_weekly),
        "impression_share_weekly": _on_campaigns(questions.impression_share_weekly),
        "social_display_weekly_ctr": _on_segments(questions.weekly_ctr),
        "wasted_spend_total": _on_waste(questions.wasted_spend_total),
        "wasted_spend_by_channel": _on_waste(questions.wasted_spend_by_channel),
        "champion_vs_stale_gap": _on_predictions(questions.champion_vs_stale_gap),
        "champion_tracking": _on_predictions(questions.champion_tracking),
        "accuracy_lift_by_channel": _on_predictions(questions.accuracy_lift_by_channel),
        "kpi_row": kpi_row,
        "predicted_vs_actual_weekly": _on_predictions(questions.predicted_vs_actual_weekly),
        "ctr_by_channel_before_after": _on_campaigns(questions.ctr_by_channel_before_after),
        "worst_segments": _on_waste(questions.worst_segments),
        "segment_gaps": _on_waste(questions.segment_gaps),
        "cohort_ctr": _on_segments(questions.cohort_ctr),
        "mix_share_by_regime": _on_campaigns(questions.mix_share_by_regime),
        "segment_count": _on_segments(questions.segment_count),
        "group_mean_predictions": lambda spark, sf_dir: rounded(_predictions(spark, sf_dir)),
        "prior_as_stale": prior_as_stale,
        "model_metrics": _on_predictions(questions.model_metrics),
        "feature_frame": feature_frame,
        "one_hot_wide": one_hot_wide,
        "level_ids": level_ids,
        "training_weights": training_weights,
        "hash_split": hash_split,
        "slice_daily": slice_daily,
        "slice_baseline": slice_baseline,
        "monitoring_metrics": monitoring_metrics,
        "health_latest_overall": _on_metrics(monitoring.health_latest_overall),
        "health_trend": _on_metrics(monitoring.health_trend),
        "health_slices_latest": _on_metrics(monitoring.health_slices_latest),
        "retrain_decision": retrain_decision,
        "decision_history": decision_history,
        "promotion_gate": promotion_gate,
        "dq_rows": dq_rows,
        "dq_drift_weekly": _on_segments(quality.drift_weekly),
        "dq_mix_and_waste": dq_mix_and_waste,
        "dq_segments": dq_segments,
        "dq_days_present": dq_days_present,
        "dq_campaign_channel": lambda spark, sf_dir: quality.campaigns_with_many_channels(_silver(spark, sf_dir)),
        "dq_countries": dq_countries,
        "dq_gap": dq_gap,
        "dq_metric_coverage": dq_metric_coverage,
        "hot_key_join": hot_key_join,
        "refresh_by_day": refresh_by_day,
        "refresh_by_day_campaigns": refresh_by_day_campaigns,
        "monitoring_incremental": monitoring_incremental,
        "written_tables": written_tables,
        "decision_log": decision_log,
        "gbt_scored": gbt_scored,
        "hpo_leaderboard": hpo_leaderboard,
        "feature_importance": feature_importance,
        "model_facts": model_facts,
        "retrain_summary": retrain_summary,
        "dq_registry": dq_registry,
    }

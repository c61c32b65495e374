"""The three jobs: refresh the daily tables, monitor the live model, retrain it."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decisions import RetrainPolicy, as_utc, overall_slice, promotion_gate, retrain_decisions
from ..operators.layers import campaign_daily_from_segments, segment_ctr_daily, silver_impressions
from ..sources.commits import Journal
from ..sources.day_tables import read_days, replace_days
from ..sources.tables import (
    append_table, create_database, current_version, literal_rows, optional_table, overwrite_table, replace_table,
)
from .features import feature_frame
from .monitoring import MonitorConfig, monitoring_metrics
from .questions import model_metrics
from .registry import register_version, set_alias, tag_version
from .scoring import MAX_CTR, incumbent_rmse, score_against_prior, score_both
from .training import (
    STALE_PARAMS, Trained, TrainingConfig, feature_importance, run_record, run_table, top_features, train_champion,
    train_stale,
)

# Table names.
SILVER = "silver_impressions"
SEGMENTS = "gold_segment_ctr_daily"
CAMPAIGNS = "gold_campaign_daily"
PREDICTIONS = "gold_ctr_predictions"
METRICS = "gold_model_monitoring_metrics"
DECISIONS = "model_retrain_decisions"
RUNS = "training_runs"
IMPORTANCES = "training_importances"

# The fields of the jobs' results.
SUMMARY_SCHEMA = (
    "model_name string, candidate_version int, promoted boolean, promotion_reason string, "
    "candidate_drift_rmse double, incumbent_drift_rmse double, feature_set string, "
    "rows_scored bigint, run_id string, top_features string"
)
INITIAL_SCHEMA = (
    "champion_version int, stale_version int, champion_feature_set string, champion_rmse_val double, "
    "stale_rmse_drift double, champion_rmse_drift double, rmse_improvement_pct double, "
    "segments_scored bigint, top_features string"
)

#: Features named in a job's result; the table has all.
NAMED_FEATURES = 10


def refresh_tables(
    spark: SparkSession,
    raw: DataFrame,
    database: str,
    drift_start: date,
    drift_campaigns: list[str],
    partition_silver_by: list[str] = (),
) -> dict[str, int]:
    """Write silver and the two rollups; returns the rows of each.

    Each layer is built from the table written before it: the fact is read
    once for silver and once for the segment-days, and the campaign-days come
    from the segment-days.
    """
    create_database(spark, database)
    written = {}
    silver = silver_impressions(raw, drift_start, drift_campaigns)
    written[SILVER] = overwrite_table(
        silver, f"{database}.{SILVER}",
        "Cleaned impressions, one row each, with week and drift flags", partition_silver_by,
    )
    segments = segment_ctr_daily(spark.table(f"{database}.{SILVER}"))
    written[SEGMENTS] = replace_table(
        segments, f"{database}.{SEGMENTS}", "Actual click rates, one row per segment and day"
    )
    campaigns = campaign_daily_from_segments(spark.table(f"{database}.{SEGMENTS}"))
    written[CAMPAIGNS] = replace_table(
        campaigns, f"{database}.{CAMPAIGNS}", "Daily rollup, one row per campaign and day"
    )
    return written


def refresh_days(
    spark: SparkSession,
    raw: DataFrame,
    root: str,
    days: list[date],
    drift_start: date,
    drift_campaigns: list[str],
) -> dict[str, int]:
    """Rebuild silver and the two rollups for some days only; returns the version of each.

    ``raw`` may hold other days, too; they are left out by a filter on the day. Each
    layer reads only the days that were written for it before.
    """
    changed = raw.where(F.col("event_date").isin(days))
    versions = {SILVER: replace_days(silver_impressions(changed, drift_start, drift_campaigns), f"{root}/{SILVER}", days)}
    segments = segment_ctr_daily(read_days(spark, f"{root}/{SILVER}", days))
    versions[SEGMENTS] = replace_days(segments, f"{root}/{SEGMENTS}", days)
    campaigns = campaign_daily_from_segments(read_days(spark, f"{root}/{SEGMENTS}", days))
    versions[CAMPAIGNS] = replace_days(campaigns, f"{root}/{CAMPAIGNS}", days)
    return versions


def run_monitor(
    spark: SparkSession,
    database: str,
    now: datetime,
    config: MonitorConfig = MonitorConfig(),
    policy: RetrainPolicy = RetrainPolicy(),
) -> DataFrame:
    """Write the metrics, decide from what was written, append the decision, and return it.

    A run for an instant that the log has already adds nothing and returns what was decided then.
    """
    stamp = F.lit(as_utc(now)).cast("timestamp")
    metrics = monitoring_metrics(spark.table(f"{database}.{PREDICTIONS}"), config, stamp)
    replace_table(metrics, f"{database}.{METRICS}", "Accuracy of the live model per slice and window")
    log = optional_table(spark, f"{database}.{DECISIONS}")
    if log is None or log.where(F.col("evaluated_at") == stamp).isEmpty():
        decision = retrain_decisions(
            spark.table(f"{database}.{METRICS}"), policy, now, log=log, slices=overall_slice(spark)
        )
        append_table(decision, f"{database}.{DECISIONS}")
    return spark.table(f"{database}.{DECISIONS}").where(F.col("evaluated_at") == stamp)


def journal_of(spark: SparkSession, database: str, job: str, model_name: str, now: datetime) -> Journal:
    """The journal of one run of a job: the same job, model and instant is the same run."""
    location = spark.catalog.getDatabase(database).locationUri.rstrip("/")
    return Journal(spark, f"{location}/job_journal", f"{job} {model_name} {as_utc(now).isoformat()}")


def _stored(spark: SparkSession, artifacts: str, trained: Trained, runs: list[dict]) -> dict:
    """Save the model; what a later step, or a later attempt, needs to know of it."""
    path = f"{artifacts}/{trained.run_id}"
    trained.pipeline.write().overwrite().save(path)
    importance = [(row["feature"], row["importance"]) for row in top_features(feature_importance(spark, trained)).collect()]
    return {
        "run_id": trained.run_id, "feature_set": trained.feature_set, "metrics": trained.metrics, "path": path,
        "runs": runs, "importance": importance,
    }


def _logged(spark: SparkSession, database: str, made: dict) -> dict:
    """Add the runs and the importances of a trained model to their tables, unless they are there."""
    for table, rows in (
        (RUNS, run_table(spark, made["runs"])),
        (IMPORTANCES, literal_rows(
            spark, [(made["run_id"], name, weight) for name, weight in made["importance"]],
            "run_id string, feature string, importance double",
        )),
    ):
        log = optional_table(spark, f"{database}.{table}")
        if log is None or log.where(F.col("run_id") == made["run_id"]).isEmpty():
            append_table(rows, f"{database}.{table}")
    return {}


def _registered(spark: SparkSession, database: str, model_name: str, made: dict, now: datetime) -> int:
    """Version of the run, registered now or by an attempt that did not get to note it."""
    log = optional_table(spark, f"{database}.model_versions")
    known = log and log.where((F.col("model_name") == model_name) & (F.col("run_id") == made["run_id"])).select("version").first()
    return known["version"] if known else register_version(spark, database, model_name, made["run_id"], made["path"], now)


def _named(made: dict) -> str:
    return ", ".join(name for name, _ in made["importance"][:NAMED_FEATURES])


def train_initial(
    spark: SparkSession,
    database: str,
    model_name: str,
    artifacts: str,
    now: datetime,
    config: TrainingConfig = TrainingConfig(generation="champion_candidate"),
    stale_params: dict = STALE_PARAMS,
    upper: float = MAX_CTR,
) -> DataFrame:
    """First training: a pre-drift model and a champion, both registered and both scored.

    Every step is noted in a journal. A run that was stopped goes on after its last
    finished step when it is started again with the same instant.
    """
    frame = feature_frame(spark.table(f"{database}.{SEGMENTS}"))
    journal = journal_of(spark, database, "initial", model_name, now)

    def stale_model() -> dict:
        stale = train_stale(frame, stale_params, config.random_seed)
        return _stored(spark, artifacts, stale, [run_record(stale, "stale", "stale_baseline")])

    def champion_model() -> dict:
        champion, runs = train_champion(frame, config)
        return _stored(spark, artifacts, champion, runs)

    models, versions = {}, {}
    for alias, train in (("stale", stale_model), ("champion", champion_model)):
        made = models[alias] = journal.step(f"{alias} trained", train)
        journal.step(f"{alias} logged", lambda made=made: _logged(spark, database, made))
        versions[alias] = journal.step(
            f"{alias} registered", lambda made=made: {"version": _registered(spark, database, model_name, made, now)}
        )["version"]
        journal.step(
            f"{alias} named",
            lambda alias=alias: set_alias(spark, database, model_name, alias, versions[alias], now) or {},
        )

    def score() -> dict:
        stale, champion = (PipelineModel.load(models[alias]["path"]) for alias in ("stale", "champion"))
        scored = score_both(
            frame, stale, champion, str(versions["champion"]), upper, F.lit(as_utc(now)).cast("timestamp")
        )
        return {"rows": replace_table(
            scored, f"{database}.{PREDICTIONS}", "Predictions of the stale and the champion model"
        )}

    rows = journal.step("scored", score)["rows"]
    # The comparison uses the clamped predictions that consumers read.
    def compare() -> dict:
        return model_metrics(spark.table(f"{database}.{PREDICTIONS}")).first().asDict()

    compared = journal.step("compared", compare)
    champion = models["champion"]
    summary = (
        versions["champion"], versions["stale"], champion["feature_set"], champion["metrics"]["rmse"],
        compared["rmse_misbid_cohort_stale"], compared["rmse_misbid_cohort_champion"],
        compared["rmse_improvement_pct"], rows, _named(champion),
    )
    return literal_rows(spark, [summary], INITIAL_SCHEMA)


def retrain(
    spark: SparkSession,
    database: str,
    model_name: str,
    artifacts: str,
    now: datetime,
    config: TrainingConfig = TrainingConfig(),
    min_improvement_pct: float = 0.0,
    upper: float = MAX_CTR,
) -> DataFrame:
    """Train, register, pass the gate, and score if promoted; returns one summary row.

    Every step is noted in a journal. A run that was stopped goes on after its last
    finished step when it is started again with the same instant, and one that ended
    returns its summary again.
    """
    frame = feature_frame(spark.table(f"{database}.{SEGMENTS}"))
    journal = journal_of(spark, database, "retrain", model_name, now)
    predictions = f"{database}.{PREDICTIONS}"

    def begin() -> dict:
        # The version that is live now stays the prior one, even if scoring has to be repeated.
        return {"prior": current_version(spark, predictions), "incumbent": incumbent_rmse(optional_table(spark, predictions))}

    begun = journal.step("begun", begin)
    prior = begun["prior"] and spark.table(begun["prior"])

    def train() -> dict:
        trained, runs = train_champion(frame, config)
        return _stored(spark, artifacts, trained, runs)

    made = journal.step("trained", train)
    journal.step("logged", lambda: _logged(spark, database, made))
    version = journal.step(
        "registered", lambda: {"version": _registered(spark, database, model_name, made, now)}
    )["version"]
    candidate, incumbent = made["metrics"]["rmse_misbid_cohort"], begun["incumbent"]

    def decide() -> dict:
        gate = promotion_gate(
            literal_rows(spark, [(candidate, incumbent)], "candidate_rmse double, incumbent_rmse double"),
            min_improvement_pct,
        ).first()
        tags = {"promotion_gate": "passed" if gate["promoted"] else "failed", "promotion_reason": gate["reason"]}
        tag_version(spark, database, model_name, version, tags, now)
        return {"promoted": gate["promoted"], "reason": gate["reason"]}

    gate = journal.step("decided", decide)

    def promote() -> dict:
        set_alias(spark, database, model_name, "champion", version, now)
        return {}

    def score() -> dict:
        # The stored artifact is what gets used from here on.
        scored = score_against_prior(
            frame, PipelineModel.load(made["path"]), prior, str(version), upper, F.lit(as_utc(now)).cast("timestamp")
        )
        return {"rows": replace_table(scored, predictions, "Predictions of the previous and the current champion")}

    rows = 0
    if gate["promoted"]:
        journal.step("promoted", promote)
        rows = journal.step("scored", score)["rows"]
    summary = (
        model_name, version, gate["promoted"], gate["reason"], candidate, incumbent,
        made["feature_set"], rows, made["run_id"], _named(made),
    )
    return literal_rows(spark, [summary], SUMMARY_SCHEMA)

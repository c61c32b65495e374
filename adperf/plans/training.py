"""Weighted boosted-tree models for the click rate, adaptive search, leaderboard, importances."""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.weighted import weighted_mae, weighted_mean, weighted_r2, weighted_rmse
from ..session import checkpoint_dir, materialize
from ..sources.tables import literal_rows
from . import boosting
from .features import FEATURE_SETS, encode, fit_encoder, slot_names, training_weight, with_split

# Ranges of the hyperparameter search.
SEARCH_SPACE = {
    "n_estimators": {"type": "int", "low": 150, "high": 500},
    "max_depth": {"type": "int", "low": 3, "high": 9},
    "learning_rate": {"type": "float", "low": 0.02, "high": 0.25, "log": True},
    "subsample": {"type": "float", "low": 0.7, "high": 1.0},
    "colsample_bytree": {"type": "float", "low": 0.7, "high": 1.0},
}

# Parameters of the pre-drift model.
STALE_PARAMS = {
    "n_estimators": 300, "max_depth": 6, "learning_rate": 0.08, "subsample": 0.9, "colsample_bytree": 0.9,
}
STALE_FEATURES = "fs_b_campaign"

RUN_SCHEMA = (
    "run_id string, run_name string, feature_set string, params map<string,double>, "
    "metrics map<string,double>, tags map<string,string>"
)
IMPORTANCE_SCHEMA = "feature string, importance double"


@dataclass(frozen=True)
class TrainingConfig:
    """How to search and train."""

    n_trials: int = 4
    random_seed: int = 42
    parallel_trials: int = 3
    space: dict = field(default_factory=lambda: dict(SEARCH_SPACE))
    feature_sets: dict = field(default_factory=lambda: dict(FEATURE_SETS))
    generation: str = "retrain_candidate"


@dataclass
class Trained:
    """A fitted model with what was measured on it."""

    run_id: str
    feature_set: str
    params: dict
    encoder: PipelineModel
    model: GBTRegressionModel
    metrics: dict

    @property
    def pipeline(self) -> PipelineModel:
        return PipelineModel(stages=[*self.encoder.stages, self.model])


def draw_params(space: dict, rng: random.Random) -> dict:
    """One random point of the search space."""
    drawn = {}
    for name, bounds in space.items():
        low, high, kind = bounds["low"], bounds["high"], bounds["type"]
        if kind == "int":
            drawn[name] = rng.randint(low, high)
        elif kind == "float" and bounds.get("log"):
            drawn[name] = min(max(math.exp(rng.uniform(math.log(low), math.log(high))), low), high)
        elif kind == "float":
            drawn[name] = rng.uniform(low, high)
        else:
            raise ValueError(f"search space of {name}: unknown type {kind!r}")
    return drawn


def _unit(value: float, bounds: dict) -> float:
    """Place of a value in its range, from 0 to 1."""
    low, high = bounds["low"], bounds["high"]
    if bounds.get("log"):
        value, low, high = math.log(value), math.log(low), math.log(high)
    return (value - low) / (high - low) if high > low else 0.0


def _from_unit(place: float, bounds: dict) -> float:
    low, high = bounds["low"], bounds["high"]
    if bounds.get("log"):
        return min(max(math.exp(math.log(low) + place * (math.log(high) - math.log(low))), low), high)
    value = low + place * (high - low)
    return min(max(round(value), low), high) if bounds["type"] == "int" else value


def _density(place: float, seen: list[float]) -> float:
    """Parzen density on [0, 1]: one bell for each place that was tried, and a flat share as wide as all of them."""
    width = max(0.05, (len(seen) + 1) ** -0.5 / 2)
    total = 1.0
    for center in seen:
        mass = 0.5 * (math.erf((1 - center) / width / math.sqrt(2)) + math.erf(center / width / math.sqrt(2)))
        total += math.exp(-0.5 * ((place - center) / width) ** 2) / (width * math.sqrt(2 * math.pi) * mass)
    return total / (len(seen) + 1)


def suggest(
    space: dict, finished: Iterable[tuple[dict, float | None]], rng: random.Random, startup: int = 2, candidates: int = 24
) -> dict:
    """The next point to try, from the points tried so far and their losses.

    The best quarter of the trials counts as good. Of some points drawn near good
    ones, the one is taken whose density among good trials is highest in relation to
    that among the others; before ``startup`` trials are there, a random point.
    Trials without a loss count as bad.
    """
    finished = list(finished)
    if len(finished) < startup:
        return draw_params(space, rng)
    ordered = sorted(finished, key=lambda trial: math.inf if trial[1] is None else trial[1])
    n_good = max(1, math.ceil(len(ordered) / 4))
    chosen = {}
    for name, bounds in space.items():
        places = [_unit(params[name], bounds) for params, _ in ordered]
        good, bad = places[:n_good], places[n_good:]
        width = max(0.05, (len(good) + 1) ** -0.5 / 2)
        drawn = []
        while len(drawn) < candidates:
            pick = rng.randrange(len(good) + 1)
            place = rng.random() if pick == len(good) else rng.gauss(good[pick], width)
            if 0 <= place <= 1:
                drawn.append(place)
        best = max(drawn, key=lambda place: math.log(_density(place, good)) - math.log(_density(place, bad)))
        value = _from_unit(best, bounds)
        chosen[name] = int(value) if bounds["type"] == "int" else value
    return chosen


def fit_all(rows: DataFrame, jobs: list[boosting.Job]) -> dict[str, GBTRegressionModel]:
    """Fit all jobs on the same rows: from cells side by side, or by Spark ML where the cells are too many."""
    models = boosting.fit_models(rows, jobs)
    for job in jobs:
        if models[job.name] is None:
            encoded = materialize(boosting.collapsed(encode(rows, job.encoder), job.weight))
            models[job.name] = fit_model(encoded, job.params, job.weight, job.seed)
    return models


def fit_model(encoded: DataFrame, params: dict, weight: str, seed: int) -> GBTRegressionModel:
    """Fit weighted boosted trees of Spark ML on the encoded rows."""
    checkpoint_dir(encoded.sparkSession)
    columns = params.get("colsample_bytree", 1.0)
    regressor = GBTRegressor(
        featuresCol="features",
        labelCol="actual_ctr",
        weightCol=weight,
        predictionCol="prediction",
        maxIter=int(params["n_estimators"]),
        maxDepth=int(params["max_depth"]),
        stepSize=float(params["learning_rate"]),
        subsamplingRate=float(params.get("subsample", 1.0)),
        featureSubsetStrategy="all" if columns >= 1.0 else f"{columns:.6f}",
        checkpointInterval=10,
        seed=seed,
    )
    return regressor.fit(encoded)


def in_cohort() -> Column:
    """Rows of the drifted campaigns inside the drift window."""
    return F.col("is_drift_segment").cast("boolean") & F.col("is_drift_window").cast("boolean")


def evaluate(scored: DataFrame) -> dict:
    """Weighted metrics of one model's predictions: the mean, and then all others around it in one aggregate."""
    columns = ("actual_ctr", "prediction", "impressions")
    center = scored.agg(weighted_mean(*columns).alias("mean")).first()["mean"] or 0.0
    row = scored.agg(
        weighted_rmse(*columns, in_cohort()).alias("rmse_misbid_cohort"),
        weighted_rmse(*columns).alias("rmse"),
        weighted_mae(*columns).alias("mae"),
        weighted_r2(*columns, center=center).alias("r2"),
    ).first()
    return row.asDict()


def prepared(frame: DataFrame) -> DataFrame:
    """The feature frame with weight and split, stored once for all fits."""
    return materialize(with_split(frame.withColumn("train_weight", training_weight())))


def _train(ready: DataFrame) -> DataFrame:
    return ready.where(~F.col("is_validation"))


def _validation(ready: DataFrame) -> DataFrame:
    return ready.where("is_validation")


def train_stale(frame: DataFrame, params: dict = STALE_PARAMS, seed: int = 42) -> Trained:
    """The model that knows the time before the drift only."""
    ready = prepared(frame).where(F.col("is_drift_window") == 0)
    encoder = fit_encoder(ready, FEATURE_SETS[STALE_FEATURES])
    job = boosting.Job("stale", encoder, params, "impressions", seed)
    model = fit_all(_train(ready), [job])["stale"]
    rmse = evaluate(model.transform(encode(_validation(ready), encoder)))["rmse"]
    return Trained(uuid.uuid4().hex, STALE_FEATURES, dict(params), encoder, model, {"rmse": rmse})


def search(ready: DataFrame, config: TrainingConfig) -> list[dict]:
    """Trials of every feature set, round by round; one record per trial.

    The trials of a round, one for each feature set, are fitted side by side. The
    next round's parameters are drawn from the finished trials of the same feature
    set. Only the metrics come back to the driver.
    """
    encoders = {name: fit_encoder(ready, names) for name, names in config.feature_sets.items()}
    draws = {name: random.Random(config.random_seed + offset) for offset, name in enumerate(encoders)}
    runs: list[dict] = []
    for _ in range(config.n_trials):
        jobs = []
        for name, encoder in encoders.items():
            own = [(run["params"], run["metrics"]["rmse_misbid_cohort"]) for run in runs if run["feature_set"] == name]
            jobs.append(boosting.Job(name, encoder, suggest(config.space, own, draws[name]), "train_weight", config.random_seed))
        models = fit_all(_train(ready), jobs)

        def record(job: boosting.Job, models=models) -> dict:
            scored = models[job.name].transform(encode(_validation(ready), job.encoder))
            return {
                "run_id": uuid.uuid4().hex,
                "run_name": f"search_{job.name}",
                "feature_set": job.name,
                "params": {key: float(value) for key, value in job.params.items()},
                "metrics": evaluate(scored),
                "tags": {"model_generation": config.generation, "feature_set": job.name},
            }

        with ThreadPool(max(1, config.parallel_trials)) as pool:
            runs += pool.map(inheritable_thread_target(ready.sparkSession)(record), jobs, chunksize=1)
    return runs


def winner(runs: list[dict]) -> dict:
    """The trial with the lowest cohort RMSE; trials that saw no cohort row come last."""

    def cohort_rmse(run: dict) -> float:
        value = run["metrics"]["rmse_misbid_cohort"]
        return math.inf if value is None else value

    return min(runs, key=cohort_rmse)


def refit(ready: DataFrame, best: dict, config: TrainingConfig) -> Trained:
    """Fit the winner again and measure it on the validation rows and on the whole cohort."""
    encoder = fit_encoder(ready, config.feature_sets[best["feature_set"]])
    job = boosting.Job("refit", encoder, best["params"], "train_weight", config.random_seed)
    model = fit_all(_train(ready), [job])["refit"]
    columns = ("actual_ctr", "prediction", "impressions")
    scored = model.transform(encode(ready, encoder))
    center = scored.agg(weighted_mean(*columns, F.col("is_validation")).alias("mean")).first()["mean"] or 0.0
    row = scored.agg(
        weighted_rmse(*columns, F.col("is_validation")).alias("rmse"),
        weighted_mae(*columns, F.col("is_validation")).alias("mae"),
        weighted_r2(*columns, F.col("is_validation"), center).alias("r2"),
        weighted_rmse(*columns, in_cohort()).alias("rmse_misbid_cohort"),
    ).first()
    return Trained(uuid.uuid4().hex, best["feature_set"], best["params"], encoder, model, row.asDict())


def train_champion(frame: DataFrame, config: TrainingConfig = TrainingConfig()) -> tuple[Trained, list[dict]]:
    """Search, pick and refit; returns the model and the records of all runs."""
    ready = prepared(frame)
    runs = search(ready, config)
    trained = refit(ready, winner(runs), config)
    return trained, [*runs, run_record(trained, "champion", "automated_retrain")]


def run_record(trained: Trained, run_name: str, generation: str) -> dict:
    """The run-log record of a fitted model."""
    return {
        "run_id": trained.run_id,
        "run_name": run_name,
        "feature_set": trained.feature_set,
        "params": {key: float(value) for key, value in trained.params.items()},
        "metrics": trained.metrics,
        "tags": {"model_generation": generation, "feature_set": trained.feature_set},
    }


def run_table(spark: SparkSession, runs: list[dict]) -> DataFrame:
    """Run records as rows of the run log."""
    names = ["run_id", "run_name", "feature_set", "params", "metrics", "tags"]
    return spark.createDataFrame([tuple(run[name] for name in names) for run in runs], RUN_SCHEMA)


def leaderboard(runs: DataFrame) -> DataFrame:
    """Candidates, best cohort RMSE first."""
    metrics = ["rmse_misbid_cohort", "rmse", "mae", "r2"]
    return (
        runs.where(F.col("tags")["model_generation"].endswith("candidate"))
        .select("feature_set", "params", *[F.col("metrics")[name].alias(name) for name in metrics], "run_id")
        .orderBy(F.col("rmse_misbid_cohort").asc_nulls_last(), "run_id")
    )


def feature_importance(spark: SparkSession, trained: Trained) -> DataFrame:
    """Importance of every slot of the feature vector, by name."""
    weights = trained.model.featureImportances.toArray()
    rows = [(name, float(weight)) for name, weight in zip(slot_names(trained.encoder), weights)]
    return literal_rows(spark, rows, IMPORTANCE_SCHEMA)


def top_features(importance: DataFrame, top: int | None = None) -> DataFrame:
    """The slots by importance; all of them unless ``top`` is given."""
    ordered = importance.orderBy(F.col("importance").desc(), "feature")
    return ordered if top is None else ordered.limit(top)


def facts(ready: DataFrame, scored: DataFrame, runs: DataFrame, importance: DataFrame, upper: float) -> DataFrame:
    """Statements that hold for every sound training, as ``fact`` and ``value``: counts, and how often a rule is broken."""

    def count(df: DataFrame, name: str, *conditions: Column) -> DataFrame:
        hit = F.lit(True)
        for condition in conditions:
            hit = hit & F.coalesce(condition, F.lit(False))
        return df.agg(F.count_if(hit).alias("value")).select(F.lit(name).alias("fact"), "value")

    champion, stale = F.col("predicted_ctr_champion"), F.col("predicted_ctr_stale")
    candidate = F.col("tags")["model_generation"].endswith("candidate")
    cohort = F.col("metrics")["rmse_misbid_cohort"]
    run = F.struct("feature_set", F.array_sort(F.map_entries("params")).alias("params"))
    winners = runs.agg(
        F.min_by(run, F.when(candidate, cohort)).alias("best"), F.max(F.when(F.col("run_name") == "champion", run)).alias("picked")
    )
    inside = F.lit(True)
    for name, bounds in SEARCH_SPACE.items():
        inside = inside & F.col("params")[name].between(bounds["low"], bounds["high"])
    each_set = [
        count(runs, f"trials_{name}", candidate, F.col("feature_set") == name) for name in FEATURE_SETS
    ]
    parts = [
        count(ready, "rows_training", ~F.col("is_validation")),
        count(ready, "rows_validation", F.col("is_validation")),
        count(scored, "rows_scored"),
        count(scored, "predictions_outside_bounds", ~(champion.between(0, upper) & stale.between(0, upper))),
        count(
            scored, "gaps_that_differ",
            (F.abs(F.col("ctr_gap_champion") - (champion - F.col("actual_ctr"))) > 1e-12)
            | (F.abs(F.col("ctr_gap_stale") - (stale - F.col("actual_ctr"))) > 1e-12),
        ),
        count(runs, "trials", candidate),
        *each_set,
        count(runs, "parameters_outside_space", candidate, ~inside),
        count(winners, "winner_is_not_the_minimum", ~F.col("best").eqNullSafe(F.col("picked"))),
        count(importance, "importances_below_zero", F.col("importance") < 0),
        count(importance.agg(F.sum("importance").alias("total")), "importances_do_not_add_up", F.abs(F.col("total") - 1) > 1e-9),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
